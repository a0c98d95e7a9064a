"""Batch scoring of rent requests against a market context.

Columns of a request: ``request_id, size_sqm, bedrooms, bathrooms, property_type`` and optionally
``furnishing, district, location, city``. A predictor is a function that adds ``raw_price``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentlens import vocab
from rentlens.functions import text as T
from rentlens.functions.features import room_features, type_flags
from rentlens.functions.numeric import round_even, weighted_mean, within
from rentlens.operators.clean import evaluate_once
from rentlens.operators.context import MarketContext, nearest_bucket
from rentlens.operators.lookup import lookup_join
from rentlens.operators.places import resolve_district

Predictor = Callable[[DataFrame], DataFrame]


def _request() -> tuple[Column, Column, Column]:
    return (F.col("size_sqm").cast("double"), F.col("bedrooms").cast("double"), F.col("bathrooms").cast("double"))


def attach_market(
    requests: DataFrame, ctx: MarketContext, kind=T.model_type, cutoff: float | None = vocab.FUZZY_CUTOFF,
    columns: Sequence[str] = ("district", "location", "city"), scoped_to=None,
) -> DataFrame:
    """Add the model type, the resolved district and the district's price and share."""
    df = requests.withColumn("kind", kind(F.col("property_type")))
    df = resolve_district(df, ctx.tables["district"], columns, cutoff, scoped_to)
    return lookup_join(df, ctx.tables["district"].drop("n"), ["district_key"], small=ctx.small_districts)


def attach_type(df: DataFrame, ctx: MarketContext) -> DataFrame:
    return lookup_join(df, ctx.tables["type"].drop("n"), ["kind"], small=ctx.small_types)


def serve_features(df: DataFrame, ctx: MarketContext) -> DataFrame:
    """Model features of requests, by the expressions used in training."""
    size, bed, bath = _request()
    o = ctx.overall
    furnishing = F.col("furnishing") if "furnishing" in df.columns else F.lit(None).cast("string")
    return df.withColumns(
        {
            "size_sqm": size, "bedrooms": bed, "bathrooms": bath,
            **room_features(size, bed, bath),
            **type_flags(F.col("kind")),
            "furnished_score": T.furnished_flag(furnishing),
            "district_freq": F.coalesce(F.col("freq"), F.lit(0.5)),
            **{c: F.lit(float(o[c])) for c in ("post_month", "post_dayofweek", "post_quarter")},
            **{f"{c}_was_missing": F.lit(0.0) for c in vocab.STRUCTURAL},
        }
    )


def model_predictor(model: PipelineModel, ctx: MarketContext) -> Predictor:
    """Predictor from a fitted pipeline whose output column is ``prediction``.

    The columns of the request are carried under other names one by one: what no later step reads is not
    copied with each row, as it would be in a struct.
    """

    def predict(df: DataFrame) -> DataFrame:
        kept = {c: f"kept_{i}" for i, c in enumerate(df.columns)}
        carried = df.select("*", *[F.col(f"`{c}`").alias(k) for c, k in kept.items()])
        scored = model.transform(serve_features(carried, ctx))
        return scored.select(*[F.col(k).alias(c) for c, k in kept.items()], F.col("prediction").alias("raw_price"))

    return predict


def market_price(ctx: MarketContext) -> Column:
    """District price, else type price, else overall price."""
    return F.coalesce("district_price", "type_price", F.lit(float(ctx.overall["overall_price"])))


def relation_anchor() -> Column:
    """Weighted mean of the market price and the prices that size, bedrooms and bathrooms suggest."""
    w = vocab.ANCHOR_WEIGHTS
    return weighted_mean([(w["market"], F.col("market_price")), (w["type"], F.col("size_price")),
                          (w["bedrooms"], F.col("bedroom_price")), (w["bathrooms"], F.col("bathroom_price"))])


def suggested_prices(df: DataFrame, ctx: MarketContext) -> DataFrame:
    """Add the parts of the relation anchor."""
    size, bed, bath = _request()
    return df.withColumns({
        "market_price": market_price(ctx),
        "size_price": within(size, lo=1.0) * F.col("type_pps"),
        "bedroom_price": nearest_bucket(bed, ctx.buckets["bedrooms"], 0),
        "bathroom_price": nearest_bucket(bath, ctx.buckets["bathrooms"], 1),
    })


def _profile(ctx: MarketContext) -> tuple[Column, Column, Column]:
    """Expected size, bedrooms and bathrooms of the type, or of the market."""
    names = {"size_sqm": "overall_size", "bedrooms": "overall_bed", "bathrooms": "overall_bath"}
    return tuple(F.coalesce(f"profile_{c}", F.lit(float(ctx.overall[o]))) for c, o in names.items())


def coherence(ctx: MarketContext) -> Column:
    """How well the layout fits the type, in [0.35, 1]."""
    size, bed, bath = _request()
    want_size, want_bed, want_bath = _profile(ctx)
    want_bed, want_bath = within(want_bed, lo=0.5), within(want_bath, lo=1.0)
    want_rooms = within(want_bed + want_bath, lo=1.0)
    size, bed, bath = within(size, lo=1.0), within(bed, lo=0.0), within(bath, lo=1.0)
    rooms = within(bed + bath, lo=1.0)
    ratios = [
        rooms / want_rooms,
        (bed + 0.5) / (want_bed + 0.5),
        (bath + 0.5) / (want_bath + 0.5),
        within(size / rooms, lo=1.0) / within(want_size / want_rooms, lo=1.0),
    ]
    mismatch = sum((F.abs(F.ln(within(r, lo=1e-6))) for r in ratios), F.lit(0.0))
    return within(F.exp(mismatch * -0.28), 0.35, 1.0)


def expected_pps(ctx: MarketContext) -> Column:
    """Expected rent per square metre from type, density and rooms."""
    size, bed, bath = _request()
    o = ctx.overall
    _, want_bed, want_bath = _profile(ctx)
    base = F.coalesce("type_pps", F.lit(float(o["overall_pps"])))
    market_rooms = max(o["overall_bed"] + o["overall_bath"], 1.0)
    market_per_room = max(o["overall_size"] / market_rooms, 1.0)
    want_per_room = F.when(F.col("profile_size_per_room") > 0, F.col("profile_size_per_room")).otherwise(market_per_room)
    per_room = within(size / within(bed + bath, lo=1.0), lo=1.0)
    density = within(F.pow(within(per_room / want_per_room, lo=1e-6), F.lit(0.18)), 0.88, 1.16)
    rooms = within((bed - want_bed) * 0.08 + (bath - want_bath) * 0.05 + 1.0, 0.82, 1.45)
    return base * density * rooms


def pps_limits(ctx: MarketContext) -> tuple[float, float]:
    o = ctx.overall
    low = max(0.8, min(o["pps_low"], o["overall_pps"] * 0.75))
    return low, max(low + 2.0, o["pps_high"], o["overall_pps"] * 1.8)


def calibrate(df: DataFrame, ctx: MarketContext) -> DataFrame:
    """Add ``market_price, relation_anchor, coherence, expected_pps, price`` to rows with ``raw_price``."""
    size, bed, bath = _request()
    size = within(size, lo=1.0)
    low, high = pps_limits(ctx)
    # each behind a generator: one method with all these formulas is over the size that the JVM compiles
    df = evaluate_once(suggested_prices(df, ctx), {"relation_anchor": relation_anchor(), "coherence": coherence(ctx)})
    df = evaluate_once(df, {"expected_pps": expected_pps(ctx)})
    blended = F.col("coherence") * F.col("raw_price") + (1.0 - F.col("coherence")) * F.col("relation_anchor")
    floor, roof = within(F.col("expected_pps") * 0.72, lo=low), within(F.col("expected_pps") * 1.35, hi=high)
    wide = roof > floor
    floor, roof = F.when(wide, floor).otherwise(low), F.when(wide, roof).otherwise(high)
    steady = within(blended / size, lo=0.01) * 0.60 + F.col("expected_pps") * 0.40
    premium = within(within(bed - 1.0, lo=0.0) * 0.060 + within(bath - 1.0, lo=0.0) * 0.040 + 1.0, 1.0, 1.55)
    least = within(size * low, lo=50.0)
    most = F.greatest(least + 50.0, size * high)
    df = df.withColumn("steady_pps", within(steady, floor, roof))
    price = within(F.col("steady_pps") * size * premium, least, most)
    return df.withColumn("price", F.when(F.col("raw_price").isNotNull(), price)).drop(
        "steady_pps", "size_price", "bedroom_price", "bathroom_price"
    )


def score(df: DataFrame, predict: Predictor, ctx: MarketContext) -> DataFrame:
    """Calibrated price of rows that carry ``kind`` and the district columns."""
    return calibrate(predict(attach_type(df, ctx)), ctx)


def reference_type(ctx: MarketContext) -> Column:
    """Type to compare a request with: the dominant one, or for that one the furthest in price."""
    if not ctx.has_types:
        return F.col("kind")
    dominant = ctx.overall["dominant_type"]
    return F.when(F.col("kind") != dominant, F.lit(dominant)).otherwise(F.coalesce(F.lit(ctx.contrast), F.col("kind")))


def _variant(role: str, label: str, kind=None, size=None, bed=None, bath=None) -> Column:
    """One changed copy of a request; a layout copy gets its bathrooms later."""
    current = {"kind": F.col("kind"), "size_sqm": F.col("size_sqm"), "bedrooms": F.col("bedrooms"),
               "bathrooms": F.col("bathrooms")}
    changed = {"kind": kind, "size_sqm": size, "bedrooms": bed, "bathrooms": bath}
    return F.struct(
        F.lit(role).alias("role"), F.lit(label).alias("label"),
        *[(current[c] if v is None else v).cast("string" if c == "kind" else "double").alias(c)
          for c, v in changed.items()],
    )


def impact_variants(ctx: MarketContext) -> list[Column]:
    """The request with one field replaced by a reference value. Needs the type's profile columns."""
    size, bed, bath = _request()
    want_size, want_bed, want_bath = _profile(ctx)
    near = F.abs(want_size - size) < 2.0
    ref_size = round_even(F.when(near, within(size * 0.75, lo=6.0)).otherwise(want_size), 2)
    ref_bed, ref_bath = round_even(want_bed), within(round_even(want_bath), lo=1.0)
    step = lambda v, lo: F.when(v < 8, v + 1).otherwise(within(v - 1, lo=lo))
    ref_bed = F.when(ref_bed == bed, step(bed, 0.0)).otherwise(ref_bed)
    ref_bath = F.when(ref_bath == bath, step(bath, 1.0)).otherwise(ref_bath)
    kind_label, size_label, bed_label, bath_label = vocab.IMPACT_LABELS
    return [
        _variant("impact", kind_label, kind=reference_type(ctx)),
        _variant("impact", size_label, size=ref_size),
        _variant("impact", bed_label, bed=ref_bed),
        _variant("impact", bath_label, bath=ref_bath),
    ]


def curve_variants(sizes: Sequence[float] = tuple(vocab.CURVE_SIZES)) -> list[Column]:
    return [_variant("curve", str(s), size=F.lit(float(s))) for s in sizes]


def with_row_key(df: DataFrame) -> DataFrame:
    """Requests with ``row_key``, a hash of all their columns: ids may repeat, and equal rows fold together.

    A hash passes over nulls, so which columns are null is hashed with them.
    """
    columns = [F.col(f"`{c}`") for c in df.columns if c != "row_key"]
    return df.withColumn("row_key", F.xxhash64(*columns, F.array(*[c.isNull() for c in columns])))


def _each_row(folded: DataFrame) -> DataFrame:
    """One row for each request again: ``rows`` equal ones were folded together."""
    return folded.withColumn("row", F.explode(F.sequence(F.lit(1), F.greatest("rows", F.lit(1).cast("long"))))).drop("row", "rows", "row_key")


def score_variants(
    df: DataFrame, predict: Predictor, ctx: MarketContext, others: Sequence[Column] = (), layouts: bool = False,
    large: int = 10_000,
) -> DataFrame:
    """Score changed copies of each request in one batch: ``request_id, asked, role, label, price, ...``.

    ``df`` comes from ``attach_market``. ``layouts`` adds every layout with at most the rooms of the
    request: a layout lifts the price by 1 % per bedroom and 0.5 % per bathroom it has less, so the
    largest lifted price is what stepping through all layouts would give.

    Requests are spread by id before they are multiplied, which makes the work even. A request with
    more than ``large`` layouts is first cut into one slice per bedroom count.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bed, bath = within(F.col("bedrooms").cast("int"), lo=0), within(F.col("bathrooms").cast("int"), lo=1)
    asked = attach_type(with_row_key(df), ctx)
    profile = [c for c in ctx.tables["type"].columns if c not in ("kind", "n")]
    carried = ["row_key", *[c for c in df.columns if c not in ("kind", "size_sqm", "bedrooms", "bathrooms", "row_key")]]

    is_large = F.lit(layouts) & ((bed + 1).cast("long") * bath > large)
    slices = F.when(is_large, F.sequence(F.lit(0), bed)).otherwise(F.array(F.lit(-1)))
    asked = asked.withColumn("slice", F.explode(slices)).repartition(tasks, "request_id", "slice")
    copies = [F.slice(F.array(*others), F.lit(1), F.when(F.col("slice") <= 0, len(others)).otherwise(0))] if others else []
    if layouts:
        beds = F.when(F.col("slice") >= 0, F.array("slice")).otherwise(F.sequence(F.lit(0), bed))
        copies.append(F.transform(beds, lambda b: _variant("layout", "", bed=b)))
    asked = asked.withColumn("variant", F.explode(F.concat(*copies)))
    is_layout = F.col("variant.role") == "layout"
    baths = F.when(is_layout, F.sequence(F.lit(1), bath).cast("array<double>")).otherwise(F.array("variant.bathrooms"))
    rows = asked.withColumn("variant_baths", F.explode(baths)).select(
        F.struct("kind", "size_sqm", "bedrooms", "bathrooms").alias("asked"), *carried,
        F.col("variant.role").alias("role"), F.col("variant.label").alias("label"),
        "variant.kind", "variant.size_sqm", "variant.bedrooms", F.col("variant_baths").alias("bathrooms"),
    ).drop(*profile)
    lift = F.pow(F.lit(1.01), F.col("asked.bedrooms") - F.col("bedrooms")) * F.pow(
        F.lit(1.005), F.col("asked.bathrooms") - F.col("bathrooms")
    )
    rows = rows.withColumn("weight", F.when(F.col("role") == "layout", lift).otherwise(1.0))
    return score(rows, predict, ctx)


def _is_base() -> Column:
    return (
        (F.col("role") == "layout") & (F.col("bedrooms") == F.col("asked.bedrooms"))
        & (F.col("bathrooms") == F.col("asked.bathrooms"))
    )


def room_monotone(df: DataFrame, predict: Predictor, ctx: MarketContext) -> DataFrame:
    """Price that never falls when rooms are added: ``request_id, price, monotone_price``."""
    cells = score_variants(df, predict, ctx, layouts=True)
    return _each_row(cells.groupBy("request_id", "row_key").agg(
        F.max(F.when(_is_base(), F.col("price"))).alias("price"),
        F.max(F.col("price") * F.col("weight")).alias("monotone_price"),
        F.count_if(_is_base()).alias("rows"),
    ))


def with_impacts(df: DataFrame, digits: int) -> DataFrame:
    """Add ``impacts``: share of each single-field change in the sum of the changes, largest first.

    Sorted once a row, without lambda functions, which are interpreted; a filter that the optimizer infers from
    exploding the impacts does not repeat them.
    """
    places = range(len(vocab.IMPACT_LABELS))
    gaps = [F.abs(F.col("price") - F.col(f"impact_{i}")) for i in places]
    total = sum(gaps[1:], gaps[0])
    ordered = F.sort_array(F.array(*[
        F.struct((-gap).alias("order"), F.lit(i).alias("position"), F.lit(label).alias("label"))
        for i, (gap, label) in enumerate(zip(gaps, vocab.IMPACT_LABELS, strict=True))
    ]))
    df = evaluate_once(df, {"ordered_gaps": ordered, "total_gap": total})
    gap = lambda i: F.get("ordered_gaps", F.lit(i))
    shares = F.array(*[F.struct(
        gap(i)["label"].alias("feature"), round_even(-gap(i)["order"] / F.col("total_gap") * 100.0, digits).alias("weight")
    ) for i in places])
    fixed = F.array(*[F.struct(F.lit(n).alias("feature"), F.lit(w).alias("weight")) for n, w in vocab.DEFAULT_IMPACTS])
    impacts = F.when(F.col("total_gap") > 0, shares).otherwise(fixed)
    return evaluate_once(df, {"impacts": impacts}).drop("ordered_gaps", "total_gap")


def score_requests(
    df: DataFrame, predict: Predictor, ctx: MarketContext, impacts: bool = True, curve: bool = True,
    sizes: Sequence[float] = tuple(vocab.CURVE_SIZES), impact_digits: int = 1,
) -> DataFrame:
    """Final price of each request with feature impacts and size curve.

    All copies of a request (layouts, single-field changes, curve sizes) are scored in one batch and
    folded back by one aggregation of numbers. ``df`` comes from ``attach_market`` and has a
    ``request_id``.
    """
    others = (impact_variants(ctx) if impacts else []) + (curve_variants(sizes) if curve else [])
    rows = score_variants(df, predict, ctx, others, layouts=True)
    pick = lambda test, c, name: F.max(F.when(test, F.col(c))).alias(name)
    role = F.col("role")
    folded = [
        F.max(F.when(role == "layout", F.col("price") * F.col("weight"))).alias("price"),
        pick(_is_base(), "market_price", "market_price"), pick(_is_base(), "coherence", "coherence"),
        F.count_if(_is_base()).alias("rows"),
    ]
    if impacts:
        folded += [pick((role == "impact") & (F.col("label") == label), "price", f"impact_{i}")
                   for i, label in enumerate(vocab.IMPACT_LABELS)]
    if curve:
        folded += [pick((role == "curve") & (F.col("label") == str(size)), "price", f"curve_{i}")
                   for i, size in enumerate(sizes)]
    out = _each_row(rows.groupBy("request_id", "row_key").agg(*folded))
    if impacts:
        out = with_impacts(out, impact_digits)
    if curve:
        points = [F.struct(F.lit(float(size)).alias("size"), round_even(F.col(f"curve_{i}"), 2).alias("price"))
                  for i, size in enumerate(sizes)]
        out = out.withColumn("size_curve", F.array(*points))
    return out.drop(*[c for c in out.columns if c.startswith(("impact_", "curve_"))])


def respond(df: DataFrame, ctx: MarketContext, model_name: str = "model") -> DataFrame:
    """Response table: rounded price, ten per cent band, note, regions, market comparison."""
    regions = F.array(*[F.struct(F.lit(n).alias("location"), F.lit(float(p)).alias("price")) for n, p in ctx.regions[:4]])
    if not ctx.regions:
        regions = F.array(*[
            F.struct(F.lit(n).alias("location"), round_even(F.col("price") * f, 2).alias("price"))
            for n, f in vocab.SAMPLE_REGIONS
        ])
    percent = round_even(F.col("coherence") * 100).cast("int").cast("string")
    price, market = F.col("price"), F.col("market_price")
    diff = F.when(market > 0, (price - market) / market * 100).otherwise(0.0)
    return df.select(
        "request_id",
        round_even(price, 2).alias("predicted_price"),
        round_even(price * 0.90, 2).alias("price_range_low"),
        round_even(price * 1.10, 2).alias("price_range_high"),
        F.lit(model_name).alias("model_used"),
        F.concat(F.lit("Estimated range ±10%. Relation coherence for this layout: "), percent, F.lit("%.")).alias("confidence_note"),
        *[c for c in ("impacts", "size_curve") if c in df.columns],
        regions.alias("regions"),
        round_even(market, 2).alias("average_market_price"),
        F.round(F.abs(diff), 1).alias("market_diff_pct"),
        (diff > 0).alias("above_market"),
    )


def to_records(df: DataFrame, column: str) -> DataFrame:
    """Array of structs as JSON text."""
    return df.withColumn(column, F.to_json(F.col(column)))
