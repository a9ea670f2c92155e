"""Shortening event histories.

The working form is one row per event: the example keys, ``idx`` (position, DOUBLE because synthetic
events sit between two positions), ``code``, ``day`` (before the prediction), ``num``, ``synthetic``.

No step needs a whole history in one task: anchors are matched inside time slices, repeats are
found by aggregation, and eras are built from partial eras of bounded stretches. Events whose code is
not compressible never take part in a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqrisk.functions.arrays import array_delta_days, normalize_arrays, tail
from seqrisk.functions.codes import is_diagnosis_name, is_visit_anchor
from seqrisk.functions.scalars import count_bin, duration_bin, recency_bin
from seqrisk.plans.joins import lookup_join, stored, wide_partitions

ANCHOR_GAP_DAYS = 30.0
STRETCH = 65_536  # positions per stretch of a history that one task handles at a time
SLICES_PER_GAP = 2
STEP = 1e-4  # distance of a synthetic event from the event it follows

EVENT = ["idx", "code", "day", "num", "synthetic"]
KEYS = ["row_id"]


# ---------------------------------------------------------------- packed rows <-> events


def explode_events(df: DataFrame, keep: Sequence[str] = KEYS) -> DataFrame:
    """Packed rows to one row per event.

    A history that is packed in several rows says in ``first_pos`` at which position each begins, so the
    positions run on. Examples with an empty history have no events; whoever reports on examples joins
    from the examples (``compression_audit``, ``build_versions``).
    """
    packed = normalize_arrays(
        F.col("codes"),
        F.col("days_before_prediction"),
        F.col("delta_days") if "delta_days" in df.columns else F.array().cast("array<double>"),
        F.col("numeric_values") if "numeric_values" in df.columns else F.array().cast("array<double>"),
    )
    start = F.coalesce("_first_pos", F.lit(0))
    first = F.col("first_pos") if "first_pos" in df.columns else F.lit(0)
    exploded = df.select(*keep, first.alias("_first_pos"), F.posexplode(packed).alias("pos", "event"))
    return exploded.select(
        *keep,
        (F.col("pos") + start).cast("double").alias("idx"),
        F.col("event.code").alias("code"),
        F.col("event.day").alias("day"),
        F.col("event.num").alias("num"),
        F.lit(False).alias("synthetic"),
    )


def pack_events(
    df: DataFrame, keys: Sequence[str] = KEYS, stretch: int = STRETCH, fields: Sequence[str] = EVENT
) -> DataFrame:
    """Events to packed rows, one per stretch of ``stretch`` positions.

    A history of up to ``stretch`` positions is one row (``segment`` 0); a longer one is cut, so the
    array in a row is bounded whatever the history's length. ``events`` is sorted by position.
    """
    segment = F.floor(F.col("idx") / F.lit(float(stretch))).alias("segment")
    return df.groupBy(*keys, segment).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("events"))


def collect_sequence(
    df: DataFrame,
    keys: Sequence[str] = KEYS,
    stretch: int = STRETCH,
    more: Sequence[str] = (),
) -> DataFrame:
    """Events to parallel arrays in position order, with the gaps between kept events.

    One row per stretch: ``segment``, and ``first_pos``, the number of events in the segments before.
    ``explode_events`` reads the rows back with the positions 0, 1, 2, ... whatever the stretch. ``more``
    names further event columns to pack (as ``<name>s``).
    """
    packed = pack_events(df, keys, stretch, [*EVENT, *more])
    ends = packed.select(
        *keys, "segment", F.size("events").alias("_n"), F.element_at("events", -1)["day"].alias("_last")
    )
    order = Window.partitionBy(*keys).orderBy("segment")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    heads = ends.select(
        *keys,
        "segment",
        F.lag("_last").over(order).alias("_before"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("first_pos"),
    )
    packed = packed.join(heads.hint("shuffle_hash"), [*keys, "segment"])
    events = F.col("events")

    def field(name: str) -> Column:
        return F.transform(events, lambda e: e[name])

    return packed.select(
        *keys,
        "segment",
        "first_pos",
        field("code").alias("codes"),
        field("day").alias("days_before_prediction"),
        array_delta_days(field("day"), F.col("_before")).alias("delta_days"),
        field("num").alias("numeric_values"),
        *[field(c).alias(f"{c}s") for c in more],
    )


def history_tail(packed: DataFrame, length: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per example with the last ``length`` events of the whole history, over all its segments.

    Only segments that reach into the tail are brought together, so a row stays bounded by ``length``
    plus one stretch.
    """
    arrays = [c for c in ("codes", "token_ids", "days_before_prediction", "delta_days", "numeric_values") if c in packed.columns]
    end = F.col("first_pos") + F.size("codes")
    total = F.max(end).over(Window.partitionBy(*keys))
    near = packed.withColumn("_end", end).withColumn("_total", total).where(
        (F.col("_end") > F.col("_total") - F.lit(length)) | (F.col("_total") == 0)
    )
    rows = near.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("segment", *arrays))).alias("_s"))

    def joined(name: str) -> Column:
        return tail(F.flatten(F.transform("_s", lambda s: s[name])), length)

    return rows.select(*keys, *[joined(c).alias(c) for c in arrays])


def delta_days(df: DataFrame, keys: Sequence[str] = KEYS, stretch: int = STRETCH) -> DataFrame:
    """Add ``delta``: days since the previous kept event, never negative, 0 for the first.

    The previous event is looked up inside a stretch; the first of a stretch takes the last day of the
    stretch before, which is an aggregate.
    """
    cut = df.withColumn("_segment", F.floor(F.col("idx") / F.lit(float(stretch))))
    last = cut.groupBy(*keys, "_segment").agg(F.max_by("day", "idx").alias("_last"))
    before = last.select(
        *keys, "_segment", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_segment")).alias("_before")
    )
    inside = Window.partitionBy(*keys, "_segment").orderBy("idx")
    previous = F.coalesce(F.lag("day").over(inside), "_before")
    joined = cut.join(before.hint("shuffle_hash"), [*keys, "_segment"])
    gap = F.greatest(F.coalesce(previous - F.col("day"), F.lit(0.0)), F.lit(0.0))
    return joined.select(*df.columns, gap.alias("delta"))


# ---------------------------------------------------------------- visits


def nearest_anchor(
    events: DataFrame,
    anchor: Column,
    asks: Column,
    keys: Sequence[str] = KEYS,
    max_gap: float = ANCHOR_GAP_DAYS,
    carry: Sequence[str] = (),
    parts: int = SLICES_PER_GAP,
) -> DataFrame:
    """Nearest visit anchor of each asking event, in both directions, within ``max_gap`` days.

    Ties in days are broken by distance in position, then by the earlier anchor. Events carry the
    keys, ``idx`` and ``day``; ``anchor`` and ``asks`` say which of them are anchors and which want
    one (an anchor that asks finds itself). The result has every asking event with ``anchor_idx`` and
    ``anchor_day``, NULL where no anchor is near.

    Time is cut into slices of ``max_gap / parts`` days and an anchor is offered to the slices it can
    reach, so rows are grouped by (example, slice) in one exchange. Inside a slice two ordered passes
    find the closest anchor day on either side, and two more the closest positions on that day;
    pairs are never enumerated.
    """
    gap = F.lit(float(max_gap))
    home = F.floor(F.col("day") / F.lit(float(max_gap) / parts)) if max_gap > 0 else F.lit(0).cast("bigint")
    reach = F.lit(parts + 1)
    nothing = F.array().cast("array<bigint>")
    offers = F.when(anchor, F.sequence(home - reach, home + reach)).otherwise(nothing)
    request = F.when(asks, F.array(F.lit(None).cast("bigint"))).otherwise(nothing)
    offered = F.col("_offer").isNotNull()
    rows = (
        events.where(anchor | asks)
        .select("*", home.alias("_home"), F.explode(F.concat(offers, request)).alias("_offer"))
        .select(
            *keys,
            F.coalesce("_offer", "_home").alias("_slice"),
            "day",
            F.when(~offered, F.col("idx")).alias("idx"),
            F.when(offered, F.col("idx")).alias("_anchor"),
            F.when(~offered, F.struct(F.lit(0).alias("_"), *carry)).alias("_carry"),
        )
        .repartition(wide_partitions(events), *keys, "_slice")
    )

    def so_far(by: Sequence[str], order: Column) -> Window:
        window = Window.partitionBy(*by).orderBy(order)
        return window.rangeBetween(Window.unboundedPreceding, Window.currentRow)

    place = [*keys, "_slice"]
    anchor_day = F.when(F.col("_anchor").isNotNull(), F.col("day"))
    sided = rows.withColumn("_below", F.max(anchor_day).over(so_far(place, F.asc("day")))).withColumn(
        "_above", F.min(anchor_day).over(so_far(place, F.desc("day")))
    )
    wanted = F.filter(
        F.array_distinct(F.array("_below", "_above")), lambda d: F.abs(F.col("day") - d) <= gap
    )
    target = F.when(F.col("_anchor").isNotNull(), F.array("day")).otherwise(wanted)
    asked = sided.select(
        *place, "idx", "day", "_anchor", "_carry", F.explode_outer(target).alias("_target")
    ).withColumn("_pos", F.coalesce("_anchor", "idx"))

    spot = [*place, "_target"]
    located = asked.withColumn(
        "_before", F.max("_anchor").over(so_far(spot, F.asc("_pos")))
    ).withColumn("_after", F.min("_anchor").over(so_far(spot, F.desc("_pos"))))

    def candidate(name: str) -> Column:
        return F.when(
            F.col(name).isNotNull() & F.col("_target").isNotNull(),
            F.struct(
                F.abs(F.col("day") - F.col("_target")).alias("gap"),
                F.abs(F.col("idx") - F.col(name)).alias("distance"),
                F.col(name).alias("anchor_idx"),
                F.col("_target").alias("anchor_day"),
            ),
        )

    found = located.where(F.col("_anchor").isNull()).groupBy(*place, "idx").agg(
        F.min(F.least(candidate("_before"), candidate("_after"))).alias("_best"),
        F.first("day").alias("day"),
        F.first("_carry").alias("_carry"),
    )
    return found.select(
        *keys,
        "idx",
        "day",
        *[F.col("_carry")[c].alias(c) for c in carry],
        F.col("_best.anchor_idx"),
        F.col("_best.anchor_day"),
    )


def _bucket_name(anchor_idx: Column, day: Column) -> Column:
    """Visit of an anchor, or the rounded day (half to even) when there is none."""
    return F.coalesce(
        F.concat(F.lit("visit::"), anchor_idx.cast("long").cast("string")),
        F.concat(F.lit("day::"), F.bround(day).cast("long").cast("string")),
    )


def visit_bucket(
    events: DataFrame, keys: Sequence[str] = KEYS, max_gap: float = ANCHOR_GAP_DAYS
) -> DataFrame:
    """Add ``visit_bucket``: anchors own one, other events take their nearest anchor's."""
    carry = [c for c in events.columns if c not in {*keys, "idx", "day"}]
    anchor = is_visit_anchor(F.col("code"))
    return nearest_anchor(events, anchor, F.lit(True), keys, max_gap, carry).select(
        *events.columns, _bucket_name(F.col("anchor_idx"), F.col("day")).alias("visit_bucket")
    )


# ---------------------------------------------------------------- compression


def flag_compressible(events: DataFrame, codes: DataFrame) -> DataFrame:
    """Add ``compressible``: the event's code is in the code table."""
    listed = codes.select("code").distinct().withColumn("_listed", F.lit(True))
    joined = lookup_join(events, listed, ["code"], "left", at_hand=codes.isLocal())
    return joined.select(
        *events.columns, F.coalesce("_listed", F.lit(False)).alias("compressible")
    )


def _dedup_parts(
    flagged: DataFrame, keys: Sequence[str], max_gap: float
) -> tuple[DataFrame, DataFrame]:
    """(events of other codes, first mention of each compressible code per visit)."""
    placed = nearest_anchor(
        flagged,
        is_visit_anchor(F.col("code")),
        F.col("compressible"),
        keys,
        max_gap,
        ["code", "num", "synthetic"],
    ).withColumn("_visit", _bucket_name(F.col("anchor_idx"), F.col("day")))
    first = placed.groupBy(*keys, "code", "_visit").agg(
        F.min("idx").alias("_at"), *[F.min_by(c, "idx").alias(c) for c in ("day", "num", "synthetic")]
    )
    kept = first.withColumnRenamed("_at", "idx").select(*keys, *EVENT)
    return flagged.where(~F.col("compressible")).select(*keys, *EVENT), kept


def _ends(first: str, last: str, n: Column) -> list[Column]:
    """Aggregates for the first and last mention and the count of a group.

    Plain numbers in the buffers keep this a hash aggregation; structs would force a sort.
    ``first`` and ``last`` prefix the input columns, which lets runs be merged into eras.
    """
    return [
        F.min(f"{first}idx").alias("first_idx"),
        F.min_by(f"{first}day", f"{first}idx").alias("first_day"),
        F.min_by(f"{first}num", f"{first}idx").alias("first_num"),
        F.max(f"{last}idx").alias("last_idx"),
        F.max_by(f"{last}day", f"{last}idx").alias("last_day"),
        n.alias("n"),
    ]


def _emit(
    groups: DataFrame, keys: Sequence[str], tokens: list[tuple[Column, Column, Column, Column]]
) -> DataFrame:
    """Groups of two or more events become the listed synthetic tokens, single ones stay.

    ``groups`` has the columns of ``_ends``.
    """
    def event(idx: Column, code: Column, day: Column, num: Column, synthetic: bool) -> Column:
        return F.struct(
            idx.cast("double").alias("idx"),
            code.alias("code"),
            day.alias("day"),
            num.cast("double").alias("num"),
            F.lit(synthetic).alias("synthetic"),
        )

    single = F.array(
        event(F.col("first_idx"), F.col("code"), F.col("first_day"), F.col("first_num"), False)
    )
    many = F.array(*[event(*t, True) for t in tokens])
    out = groups.select(*keys, F.inline(F.when(F.col("n") > 1, many).otherwise(single)))
    return out.select(*keys, *EVENT)


def _first_last(kept: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First and last mention of each repeated code, single mentions as they are."""
    groups = kept.groupBy(*keys, "code").agg(*_ends("", "", F.count(F.lit(1))))
    code, first_day, last_day = F.col("code"), F.col("first_day"), F.col("last_day")
    span = F.greatest(first_day - last_day, F.lit(0.0))
    tokens = [
        (F.col("first_idx"), F.concat(F.lit("DX_FIRST/"), code), first_day, F.lit(0.0)),
        (F.col("last_idx"), F.concat(F.lit("DX_LAST/"), code), last_day, span),
    ]
    return _emit(groups, keys, tokens)


def _sessionize(df: DataFrame, within: Sequence[str], start_day: str, end_day: str, gap: float) -> DataFrame:
    """Number the runs of rows, in position order, whose day gap stays within ``gap``."""
    order = Window.partitionBy(*within).orderBy("_at")
    step = F.greatest(F.lag(end_day).over(order) - F.col(start_day), F.lit(0.0))
    opens = F.when(step > F.lit(float(gap)), 1).otherwise(0)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("_opens", opens).withColumn("_run", F.sum("_opens").over(upto)).drop("_opens")


def _partial_eras(
    events: DataFrame, keys: Sequence[str], gap: float, stretch: int
) -> tuple[DataFrame, DataFrame]:
    """Runs inside stretches, and those runs joined into eras over the whole history.

    A run only ends where the gap rule ends an era or where a stretch ends, so the second pass sees
    one row per run: at most history span / gap + number of stretches per code.
    """
    local = [*keys, "code", "_stretch"]
    cut = events.withColumn("_stretch", F.floor(F.col("idx") / F.lit(float(stretch)))).withColumn(
        "_at", F.col("idx")
    )
    runs = _sessionize(cut, local, "day", "day", gap).drop("_at").withColumnRenamed("_run", "_part")
    partial = runs.groupBy(*local, "_part").agg(*_ends("", "", F.count(F.lit(1))))
    ordered = partial.withColumn("_at", F.col("first_idx"))
    eras = _sessionize(ordered, [*keys, "code"], "first_day", "last_day", gap)
    return runs, eras.withColumnRenamed("_run", "era").drop("_at")


def split_eras(
    events: DataFrame, gap: float, keys: Sequence[str] = KEYS, stretch: int = STRETCH
) -> DataFrame:
    """Add ``era`` (0-based, per example and code): a new era starts when the gap is exceeded."""
    runs, eras = _partial_eras(events, keys, gap, stretch)
    on = [*keys, "code", "_stretch", "_part"]
    return runs.join(eras.select(*on, "era").hint("merge"), on).select(*events.columns, "era")


def _era_groups(kept: DataFrame, keys: Sequence[str], gap: float, stretch: int) -> DataFrame:
    _, eras = _partial_eras(kept, keys, gap, stretch)
    return eras.groupBy(*keys, "code", "era").agg(*_ends("first_", "last_", F.sum("n")))


def _condition_era(kept: DataFrame, keys: Sequence[str], gap: int, stretch: int = STRETCH) -> DataFrame:
    """Eras of two or more mentions become start, end and binned-count tokens."""
    groups = _era_groups(kept, keys, gap, stretch)
    first_idx, first_day, last_idx, last_day, code, n = map(
        F.col, ("first_idx", "first_day", "last_idx", "last_day", "code", "n")
    )
    span = F.greatest(first_day - last_day, F.lit(0.0))
    name = f"DX_ERA{gap}"
    counted = F.concat(F.lit(f"{name}_COUNT_BIN/"), count_bin(n), F.lit("/"), code)
    tokens = [
        (first_idx, F.concat(F.lit(f"{name}_START/"), code), first_day, F.lit(0.0)),
        (last_idx + STEP, F.concat(F.lit(f"{name}_END/"), code), last_day, span),
        (last_idx + 2 * STEP, counted, last_day, n),
    ]
    return _emit(groups, keys, tokens)


def _state_duration(kept: DataFrame, keys: Sequence[str], gap: int, stretch: int = STRETCH) -> DataFrame:
    """Eras of two or more mentions become onset, active, duration, count and recency tokens."""
    groups = _era_groups(kept, keys, gap, stretch)
    first_idx, first_day, last_idx, last_day, code, n = map(
        F.col, ("first_idx", "first_day", "last_idx", "last_day", "code", "n")
    )
    span = F.greatest(first_day - last_day, F.lit(0.0))
    recency = F.greatest(last_day, F.lit(0.0))
    name = f"DX_STATE{gap}"

    def binned(kind: str, label: Column) -> Column:
        return F.concat(F.lit(f"{name}_{kind}_BIN/"), label, F.lit("/"), code)

    tokens = [
        (first_idx, F.concat(F.lit(f"{name}_ONSET/"), code), first_day, F.lit(0.0)),
        (last_idx + STEP, F.concat(F.lit(f"{name}_ACTIVE/"), code), last_day, n),
        (last_idx + 2 * STEP, binned("DURATION", duration_bin(span)), last_day, span),
        (last_idx + 3 * STEP, binned("COUNT", count_bin(n)), last_day, n),
        (last_idx + 4 * STEP, binned("RECENCY", recency_bin(recency)), last_day, recency),
    ]
    return _emit(groups, keys, tokens)


def _shortener(version: str) -> Callable[[DataFrame, Sequence[str]], DataFrame] | None:
    """What a version does to the deduplicated mentions; None for the raw version."""
    if version == "raw":
        return None
    if version == "compressed_dedup":
        return lambda kept, keys: kept.select(*keys, *EVENT)
    if version == "compressed_first_last":
        return _first_last
    match = re.fullmatch(r"(condition_era|state_duration)_(\d+)", version)
    if not match:
        raise ValueError(f"Unknown compression version: {version}")
    build = _condition_era if match.group(1) == "condition_era" else _state_duration
    return lambda kept, keys: build(kept, keys, int(match.group(2)))


def compress(
    flagged: DataFrame,
    version: str,
    keys: Sequence[str] = KEYS,
    max_gap: float = ANCHOR_GAP_DAYS,
) -> DataFrame:
    """Events of one named version; era versions carry their gap in days as a suffix.

    ``raw`` passes every event through. All others keep one mention of each compressible code per
    visit and then shorten those mentions further; events of other codes stay as they are.
    """
    shorten = _shortener(version)
    if shorten is None:
        return flagged.select(*keys, *EVENT)
    untouched, kept = _dedup_parts(flagged, keys, max_gap)
    return untouched.unionByName(shorten(kept, keys))


def compress_versions(
    flagged: DataFrame,
    versions: Sequence[str],
    keys: Sequence[str] = KEYS,
    max_gap: float = ANCHOR_GAP_DAYS,
) -> DataFrame:
    """Several versions in one table, with a ``version`` column.

    The deduplicated mentions are made and stored once for all versions, and the events that no
    version touches are read once.
    """
    steps = {v: _shortener(v) for v in versions}
    short = [v for v in versions if steps[v] is not None]
    parts = [
        flagged.select(*keys, *EVENT, F.lit(v).alias("version")) for v in versions if steps[v] is None
    ]
    if short:
        untouched, kept = _dedup_parts(flagged, keys, max_gap)
        if len(short) > 1:
            kept = stored(kept)
        parts.append(untouched.withColumn("version", F.explode(F.array(*[F.lit(v) for v in short]))))
        parts += [steps[v](kept, keys).withColumn("version", F.lit(v)) for v in short]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def compression_audit(
    flagged: DataFrame,
    compressed: DataFrame,
    keys: Sequence[str] = KEYS,
    diagnosis: Column | None = None,
    examples: DataFrame | None = None,
    versions: Sequence[str] = (),
) -> DataFrame:
    """Per example and version: lengths, removed (may be negative) and synthetic counts.

    ``diagnosis`` is the predicate behind ``n_diagnosis_like_events_raw``; with a code list loaded it
    is the ``compressible`` flag, without one the name rule. With ``examples`` (the keys) and ``versions``
    every example has a row for every version, those without events with zeros.
    """
    like = is_diagnosis_name(F.col("code")) if diagnosis is None else diagnosis
    raw = flagged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("raw_seq_len"),
        F.count_if(like).alias("n_diagnosis_like_events_raw"),
        F.count_if("compressible").alias("n_compressible_chronic_events_raw"),
    )
    # Counted in an explicit number of tasks: groups are nearly as many as events, so a task's table of them is as large as its rows.
    place = F.floor(F.col("idx") / STRETCH)
    spread = compressed.repartition(wide_partitions(compressed), *keys, place)
    per_code = spread.groupBy(*keys, "version", "code").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if("synthetic").alias("_synthetic")
    )
    kept = per_code.groupBy(*keys, "version").agg(
        F.sum("_n").alias("seq_len"),
        F.count(F.lit(1)).alias("n_unique_tokens"),
        F.sum("_synthetic").alias("n_synthetic_events"),
    )
    if examples is None:
        joined = kept.join(raw.hint("merge"), list(keys))
    else:
        every = examples.select(*keys, F.explode(F.array(*[F.lit(v) for v in versions])).alias("version"))
        joined = every.join(kept.hint("merge"), [*keys, "version"], "left").join(raw.hint("merge"), list(keys), "left")
    counts = {c: F.coalesce(c, F.lit(0)) for c in joined.columns if c not in {*keys, "version"}}
    return joined.withColumns(counts).select(
        *keys,
        "version",
        "seq_len",
        "n_unique_tokens",
        "raw_seq_len",
        (F.col("raw_seq_len") - F.col("seq_len")).alias("n_events_removed_vs_raw"),
        "n_synthetic_events",
        "n_diagnosis_like_events_raw",
        "n_compressible_chronic_events_raw",
    )
