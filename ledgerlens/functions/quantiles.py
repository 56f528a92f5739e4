"""Exact statistics without gathering a column into one task.

``exact_quantiles`` returns the linearly interpolated quantile (the pandas /
numpy default) of numeric columns.  Spark's exact ``percentile`` keeps every
distinct value of the group in one aggregation buffer, which for a global
statistic means one task holds the whole column.  Instead we narrow the
search: ``percentile_approx`` (mergeable sketch, bounded memory) gives a value
interval that certainly contains the wanted ranks, a count pass tells how many
values lie below it, and only the values inside the interval are grouped and
ranked.  Rounds repeat until the interval holds at most ``max_candidates``
rows, or one value, or two neighbouring ones, so the final ranking step is
bounded whatever the size of the table.  An interval that a sketch can't
shrink, because a few values hold most of its rows, is halved by value.

``exact_modes`` is the same idea for the most frequent value: counters with an
error bound first, exact counts of the values that can still win.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .exprs import number


def _long_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    kv = F.inline(F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).cast("double").alias("v"))
                            for c in cols]))
    return df.select(kv).where(F.col("v").isNotNull() & ~F.isnan("v"))


def _lerp(a: float, b: float, t: float) -> float:
    d = b - a
    return b - d * (1.0 - t) if t >= 0.5 else a + d * t


def quantiles(df: DataFrame, specs: Sequence[tuple[str, float]], rank_error: float | None = None) -> dict[tuple[str, float], float | None]:
    """``{(column, q): value}``: exact if no ``rank_error`` is given, else values of
    the columns from one pass (``sketch_quantiles``)."""
    return exact_quantiles(df, specs) if rank_error is None else sketch_quantiles(df, specs, rank_error)


def sketch_quantiles(df: DataFrame, specs: Sequence[tuple[str, float]], rank_error: float) -> dict[tuple[str, float], float | None]:
    """A value of each column whose rank is within ``rank_error`` times the number of
    values from the wanted one, always: a mergeable sketch of about 1 / ``rank_error``
    values a task and column, one pass for all columns.  Nulls and NaN are skipped;
    a column without values gives ``None``."""
    if not 0 < rank_error < 1:
        raise ValueError("rank_error is a share of the rows, between 0 and 1")
    specs = list(dict.fromkeys((c, float(q)) for c, q in specs))
    wanted = {c: sorted({q for k, q in specs if k == c}) for c, _ in specs}
    if not specs:
        return {}
    accuracy = min(1 << 30, math.ceil(1 / rank_error))
    row = df.agg(*(F.percentile_approx(number(c), qs, accuracy).alias(f"c{i}") for i, (c, qs) in enumerate(wanted.items()))).first()
    return {(c, q): (None if row[f"c{i}"] is None else float(row[f"c{i}"][n])) for i, (c, qs) in enumerate(wanted.items()) for n, q in enumerate(qs)}


def exact_quantiles(df: DataFrame, specs: Sequence[tuple[str, float]], *,
                    max_candidates: int | None = None, accuracy: int | None = None) -> dict[tuple[str, float], float | None]:
    """Exact linear-interpolation quantiles, ``{(column, q): value}``.

    Nulls and NaN are skipped; a column with no values gives ``None``."""
    from ..config import LIMITS
    max_candidates = LIMITS.quantile_max_candidates if max_candidates is None else max_candidates
    accuracy = LIMITS.quantile_accuracy if accuracy is None else accuracy
    specs = list(dict.fromkeys((c, float(q)) for c, q in specs))
    if not specs:
        return {}
    spark = df.sparkSession
    cols = sorted({c for c, _ in specs})
    long = _long_numeric(df, cols)
    counts = {r["k"]: r["n"] for r in long.groupBy("k").agg(F.count("v").alias("n")).collect()}

    state = []
    result: dict[tuple[str, float], float | None] = {}
    for i, (c, q) in enumerate(specs):
        n = counts.get(c, 0)
        if n == 0:
            result[(c, q)] = None
            continue
        pos = q * (n - 1)
        r_lo = int(math.floor(pos))
        r_hi = min(int(math.ceil(pos)), n - 1)
        state.append(dict(t=i, k=c, q=q, pos=pos, r_lo=r_lo, r_hi=r_hi,
                          lo=None, hi=None, below=0, m=n))
    if not state:
        return result

    def candidates(sts):
        tdf = spark.createDataFrame(
            [(s["t"], s["k"], s["lo"], s["hi"]) for s in sts],
            "t int, k string, lo double, hi double")
        joined = long.join(F.broadcast(tdf), "k")
        keep = ((F.col("lo").isNull() | (F.col("v") >= F.col("lo")))
                & (F.col("hi").isNull() | (F.col("v") <= F.col("hi"))))
        return joined.where(keep).select("t", "v")

    def open_states():
        """Targets whose interval is neither one value nor few rows."""
        return [s for s in state if s["m"] > max_candidates and not s.get("gap") and (s["lo"] is None or s["lo"] != s["hi"])]

    while pending := open_states():
        # targets sharing a column and a bracket share one sketch ("slot"):
        # every row enters one percentile_approx, whatever the number of quantiles
        slots: dict[tuple, int] = {}
        for s in pending:
            s["slot"] = slots.setdefault((s["k"], s["lo"], s["hi"]), len(slots))
        sdf = spark.createDataFrame([(i, k, lo, hi) for (k, lo, hi), i in slots.items()],
                                    "slot int, k string, lo double, hi double")
        keep = ((F.col("lo").isNull() | (F.col("v") >= F.col("lo")))
                & (F.col("hi").isNull() | (F.col("v") <= F.col("hi"))))
        sub = long.join(F.broadcast(sdf), "k").where(keep).select("slot", "v")
        margin = 3.0 / accuracy
        for s in pending:
            s["f"] = (max(0.0, (s["r_lo"] - s["below"]) / s["m"] - margin),
                      min(1.0, (s["r_hi"] - s["below"] + 1) / s["m"] + margin))
        fracs = sorted({f for s in pending for f in s["f"]})
        sketch = {r["slot"]: r["q"] for r in
                  sub.groupBy("slot").agg(F.percentile_approx("v", fracs, accuracy).alias("q")).collect()}
        cnt_aggs = []
        for s in pending:
            q = sketch[s["slot"]]
            s["lo_new"], s["hi_new"] = q[fracs.index(s["f"][0])], q[fracs.index(s["f"][1])]
            mine = F.col("slot") == s["slot"]
            cnt_aggs += [F.count_if(mine & (F.col("v") < F.lit(s["lo_new"]))).alias(f"lt{s['t']}"),
                         F.count_if(mine & (F.col("v") <= F.lit(s["hi_new"]))).alias(f"le{s['t']}")]
        cnts = sub.agg(*cnt_aggs).first()
        stuck = []
        for s in pending:
            lt, le = cnts[f"lt{s['t']}"], cnts[f"le{s['t']}"]
            lo_ok = s["below"] + lt <= s["r_lo"]
            hi_ok = s["below"] + le > s["r_hi"]
            m_new = (le if hi_ok else s["m"]) - (lt if lo_ok else 0)
            if lo_ok:
                s["below"] += lt
                s["lo"] = s["lo_new"]
            if hi_ok:
                s["hi"] = s["hi_new"]
            if m_new >= s["m"] and s["lo"] != s["hi"]:
                stuck.append(s)
            s["m"] = m_new
        _bisect(long, stuck)

    # an interval of one value is that value, however many rows share it
    for s in state:
        if s["m"] > max_candidates or s.get("gap"):
            result[(s["k"], s["q"])] = s["lo"] if s["lo"] == s["hi"] else _lerp(s["lo"], s["hi"], s["pos"] - s["r_lo"])
    state = [s for s in state if s["m"] <= max_candidates and not s.get("gap")]
    if not state:
        return result

    # Final exact step: rank the (value, count) groups inside each interval.
    sub = candidates(state)
    grouped = sub.groupBy("t", "v").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("t").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = grouped.withColumn("cum", F.sum("c").over(w)).withColumn("prev", F.col("cum") - F.col("c"))
    wanted = spark.createDataFrame(
        [(s["t"], s["r_lo"] - s["below"], s["r_hi"] - s["below"]) for s in state],
        "t int, a long, b long")
    hits = (ranked.join(F.broadcast(wanted), "t")
            .where(((F.col("prev") <= F.col("a")) & (F.col("a") < F.col("cum")))
                   | ((F.col("prev") <= F.col("b")) & (F.col("b") < F.col("cum"))))
            .select("t", "v", "prev", "cum", "a", "b").collect())
    by_t: dict[int, dict[str, float]] = {}
    for h in hits:
        d = by_t.setdefault(h["t"], {})
        if h["prev"] <= h["a"] < h["cum"]:
            d["a"] = h["v"]
        if h["prev"] <= h["b"] < h["cum"]:
            d["b"] = h["v"]
    for s in state:
        d = by_t.get(s["t"], {})
        va, vb = d.get("a"), d.get("b")
        if va is None or vb is None:
            result[(s["k"], s["q"])] = None
        else:
            result[(s["k"], s["q"])] = _lerp(va, vb, s["pos"] - s["r_lo"])
    return result


def _bisect(long: DataFrame, stuck: list[dict]) -> None:
    """Halve intervals that a sketch could not shrink (a few values hold most of
    their rows): one aggregate for all, at the middle value of each.  Ends at
    the latest when an interval is one value, or its two ranks lie on either
    side of a gap between two neighbouring values."""
    if not stuck:
        return
    aggs = []
    for s in stuck:
        here = F.col("k") == s["k"]
        if s["lo"] is not None:
            here = here & (F.col("v") >= s["lo"])
        if s["hi"] is not None:
            here = here & (F.col("v") <= s["hi"])
        lo = s["lo"] if s["lo"] is not None else s["lo_new"]
        hi = s["hi"] if s["hi"] is not None else s["hi_new"]
        mid = lo / 2 + hi / 2
        mid = lo if mid >= hi else mid
        low, t = here & (F.col("v") <= mid), s["t"]
        aggs += [F.count_if(low).alias(f"n{t}"), F.max(F.when(low, F.col("v"))).alias(f"a{t}"),
                 F.min(F.when(here & ~low, F.col("v"))).alias(f"b{t}")]
    row = long.agg(*aggs).first()
    for s in stuck:
        n, top, bottom = row[f"n{s['t']}"], row[f"a{s['t']}"], row[f"b{s['t']}"]
        if s["below"] + n > s["r_hi"]:
            s["hi"], s["m"] = top, n
        elif s["below"] + n <= s["r_lo"]:
            s["lo"], s["m"], s["below"] = bottom, s["m"] - n, s["below"] + n
        else:                                     # the ranks are the two neighbours themselves
            s["lo"], s["hi"] = top, bottom
            s["gap"] = True


def exact_modes(df: DataFrame, cols: Sequence[str]) -> dict[str, str | None]:
    """Most frequent non-null value per column; ties go to the smallest value.
    Columns without a value are absent from the result.

    Columns of few different values are counted at once.  Of the others each task
    keeps its ``LIMITS.mode_counters`` most frequent values with a bound of what it
    dropped (``heavy_values``); if the most frequent one is above that bound, only
    values that can reach it are counted exactly, and a value's rows are shuffled
    no more.  A column where none is (most of its values are rare) is counted whole."""
    from ..config import LIMITS
    cols = list(cols)
    if not cols:
        return {}
    text = df.select(*[F.col(c).cast("string").alias(c) for c in cols])
    about = text.agg(*[F.approx_count_distinct(c).alias(f"c{i}") for i, c in enumerate(cols)]).first()
    many = [c for i, c in enumerate(cols) if about[f"c{i}"] > LIMITS.mode_values]
    modes = _counted_modes(_pairs(text, [c for c in cols if c not in many]))
    if many:
        survivors = stored(heavy_values(text, many, LIMITS.mode_counters), "heavy")
        known = {r["k"]: r["decided"] for r in survivors.groupBy("k").agg(F.min("decided").alias("decided")).collect()}
        undecided = [c for c in many if not known.get(c)]          # no counter is left, or none above the bound
        pairs = _pairs(text, [c for c in many if known.get(c)])
        modes |= _counted_modes(pairs and pairs.join(survivors.where("decided").select("k", "v"), ["k", "v"], "left_semi"))
        modes |= _counted_modes(_pairs(text, undecided))
    return modes


def _pairs(text: DataFrame, cols: Sequence[str]) -> DataFrame | None:
    """``k, v``: the values of text columns in long form."""
    if not cols:
        return None
    return text.select(F.inline(F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).alias("v")) for c in cols]))).where(F.col("v").isNotNull())


def _counted_modes(pairs: DataFrame | None) -> dict[str, str]:
    if pairs is None:
        return {}
    counts = pairs.groupBy("k", "v").agg(F.count(F.lit(1)).alias("c"))
    best = counts.groupBy("k").agg(
        F.min_by("v", F.struct((-F.col("c")).alias("nc"), F.col("v").alias("vv"))).alias("mode"))
    return {r["k"]: r["mode"] for r in best.collect()}


def heavy_values(text: DataFrame, cols: Sequence[str], counters: int) -> DataFrame:
    """``k, v, decided``: the values of each column that can be its most frequent one.

    Each task counts with at most ``counters`` counters a column.  When there are
    more, the count of the first one beyond is taken off all, and those that fall
    to 0 go: a value's true count is at most its counter plus all that was taken
    off, which is at most rows / counters.  ``decided`` is false for a column whose
    largest counter isn't above that bound, so that a value that went may win."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[str, int]] = {c: {} for c in cols}
        off = dict.fromkeys(cols, 0)
        for batch in batches:
            for c in cols:
                own = held[c]
                for x in pc.value_counts(batch.column(c).drop_null()).to_pylist():
                    own[x["values"]] = own.get(x["values"], 0) + x["counts"]
                if len(own) > counters:
                    less = sorted(own.values(), reverse=True)[counters]
                    held[c] = {v: n - less for v, n in own.items() if n > less}
                    off[c] += less
        rows = [(c, v, n, 0) for c in cols for v, n in held[c].items()] + [(c, None, 0, off[c]) for c in cols]
        k, v, n, o = zip(*rows)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.string()), pa.array(v, pa.string()), pa.array(n, pa.int64()), pa.array(o, pa.int64())], names=["k", "v", "n", "off"])

    kept = stored(text.select(*cols).mapInArrow(run, "k string, v string, n long, off long"), "counters")
    bound = kept.groupBy("k").agg(F.sum("off").alias("off"))                                          # a row per column
    sums = kept.where(F.col("v").isNotNull()).groupBy("k", "v").agg(F.sum("n").alias("n"))
    best = sums.groupBy("k").agg(F.max("n").alias("best")).join(bound, "k")
    near = sums.join(F.broadcast(best), "k").where(F.col("n") + F.col("off") >= F.col("best"))
    return near.select("k", "v", ((F.col("off") == 0) | (F.col("best") > F.col("off"))).alias("decided"))
