"""Benchmark decontamination by template canonicalisation.

Names, numbers and units are replaced by typed placeholders, so a question and
the same question with other values have one template.  Windows of template
tokens, and of lower-cased tokens with their values, are hash-joined at every
place, so a shared run of k tokens names an alignment (agreeing tokens that are
nowhere k in a row don't).  Each alignment is checked by itself, token by token: literal tokens must agree,
and slots must map consistently (one value of the item to one value of the
document, and back).

Only DataFrame functions are used; the values of the slots are looked at for
documents with a hit only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import sized, store

#: Window lengths for items of at least 2k - 1 tokens: a longer one for most, a short one for short items.
WINDOWS = (5, 2)
#: Share of an item's tokens that must agree with their values, or as a template with consistent slots.
EXACT_SHARE = 0.5
TEMPLATE_SHARE = 0.8
# Three private-use characters that mark the kinds of slots.
NAME, NUMBER, UNIT = "\ue001", "\ue002", "\ue003"
# Units of measure, money and time.
UNITS = ("kg mg g t lb lbs oz km cm mm m mi ft yd in l ml dl gal s sec secs ms min mins h hr hrs hours hour minutes minute seconds second days day "
         "weeks week months month years year kb mb gb tb hz khz mhz ghz w kw kwh v a mph kmh usd eur gbp dollars dollar euros euro cents pounds "
         "percent degrees meters metres meter metre kilometers grams gram kilograms liters litres miles mile feet inches")
_NAME = r"(?<=[\p{L}\p{N},;)]\s)\p{Lu}\p{Ll}\p{L}*+"
_UNIT = r"(\p{Nd})\s?((?i:" + "|".join(sorted(UNITS.split(), key=lambda u: (-len(u), u))) + r"))(?![\p{L}\p{N}])"
_NUMBER = r"\p{Nd}++(?:[.,]\p{Nd}++)*+"
_GAP = rf"[^\p{{L}}\p{{N}}{NAME}-{UNIT}.,]+|[.,](?!\p{{Nd}})|(?<!\p{{Nd}})[.,]"
_SLOTS = [NAME, NUMBER, UNIT]


def _first(t):
    return F.substring(t, 1, 1)


def _value(t):
    """The token whatever its case told: names without their mark."""
    return F.translate(t, NAME, "")


def _tokens(text: str) -> Column:
    """Lower-case tokens of a column; those that fill a slot begin with its placeholder."""
    t = F.regexp_replace(F.col(text), f"[{NAME}-{UNIT}]", " ")
    t = F.regexp_replace(t, _UNIT, f"$1 {UNIT}$2")
    t = F.regexp_replace(t, _NAME, f" {NAME}$0 ")
    t = F.regexp_replace(t, _NUMBER, f" {NUMBER}$0 ")
    return F.array_remove(F.split(F.lower(t), _GAP), "")


def _forms(rows: DataFrame) -> DataFrame:
    """``tokens`` as ``template`` (placeholders only) and as ``plain`` (values), hashed token by token."""
    literal = lambda t: (t < NAME) | (t > UNIT + "\U0010ffff")
    return (rows.withColumn("template", F.transform("tokens", lambda t: F.xxhash64(F.when(literal(t), t).otherwise(_first(t)))))
            .withColumn("plain", F.transform("tokens", lambda t: F.xxhash64(F.when(t.startswith(NAME), F.substring(t, 2, 1 << 30)).otherwise(t)))))


def _windows(tokens: str, k: int, stride: int = 1, seed: int = 0) -> Column:
    """``struct(at, hash)`` of the windows of ``k`` tokens that start at multiples of ``stride``."""
    n = F.size(tokens)
    return F.when(n >= k, F.transform(
        F.sequence(F.lit(0), n - k, F.lit(stride)),
        lambda i: F.struct(i.alias("at"), F.xxhash64(F.slice(tokens, i + 1, F.lit(k)), F.lit(seed)).alias("hash")))).otherwise(
        F.array().cast("array<struct<at:int,hash:bigint>>"))


def _index(items: DataFrame, k: int) -> DataFrame:
    """``item_hash, item_id, item_at``: windows by template, if they hold k // 2 literals, and all by value."""
    telling = F.size(F.filter(F.slice("tokens", F.col("w.at") + 1, F.lit(k)), lambda t: ~_first(t).isin(_SLOTS))) >= k // 2
    by_template = items.select("item_id", "tokens", F.explode(_windows("template", k)).alias("w")).where(telling).select("item_id", "w")
    by_value = items.select("item_id", F.explode(_windows("plain", k, seed=1)).alias("w"))
    return by_template.union(by_value).select(F.col("w.hash").alias("item_hash"), "item_id", F.col("w.at").alias("item_at"))


def _hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``row_id, text_hash, item_id, shift`` for alignments with a common window."""
    k, short = WINDOWS
    index = _index(items.where(F.col("m") >= 2 * k - 1), k)
    windows = [_windows("template", k), _windows("plain", k, seed=1)]
    if not items.where(F.col("m") < 2 * k - 1).isEmpty():
        index = index.union(_index(items.where(F.col("m") < 2 * k - 1), short))
        windows += [_windows("template", short), _windows("plain", short, short, seed=1)]    # short items agree wholly
    index = sized(store(index.distinct(), "leak-index"))
    rows = (_forms(docs.select("row_id", "text_hash", _tokens("text").alias("tokens")))
            .select("row_id", "text_hash", F.explode(F.concat(*windows)).alias("w"))
            .select("row_id", "text_hash", F.col("w.hash").alias("hash"), F.col("w.at").alias("at")))
    return (rows.join(index, F.col("hash") == F.col("item_hash"))
            .select("row_id", "text_hash", "item_id", (F.col("at") - F.col("item_at")).alias("shift")))


def _with_names(items: DataFrame) -> DataFrame:
    """``items`` (item_id, tokens) where a word that is a name anywhere in the
    benchmark is one everywhere, at the beginnings of sentences and in any case too."""
    each = items.select("item_id", F.xxhash64("tokens").alias("version"), F.posexplode("tokens").alias("at", "t"))
    names = each.where(_first(F.col("t")) == NAME).select(F.col("t").alias("name")).distinct()
    named = each.join(names, F.concat(F.lit(NAME), F.col("t")) == F.col("name"), "left")
    return (named.groupBy("item_id", "version").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("name", "t").alias("t")))).alias("x"))
            .select("item_id", F.transform("x", lambda x: x["t"]).alias("tokens")))


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
          item_text_col: str = "text") -> DataFrame:
    """``doc_id, item_id, kind, matched, item_tokens, share``: a row for each
    document and benchmark item that it holds.

    ``kind`` is ``reparameterised`` if at least 80 % of the item's tokens agree as
    a template, the slots map consistently and some have other values; else
    ``exact`` if the tokens that agree with their values, less the slots with other
    values, are at least half of the tokens (80 % if the slots map inconsistently).  Items of fewer than 9 tokens must agree wholly.
    Items of fewer than 3 tokens, null or empty items and texts match nothing;
    neither do null ids.  An item of little else than placeholders is found
    with its own values only.  Repeated documents and items give one row; versions
    of one id are looked at separately and the best counts.  Empty tables give
    no rows.
    """
    k, short = WINDOWS
    rows = docs.select(F.col(id_col).alias("row_id"), F.col(text_col).alias("text")).where("row_id is not null and length(text) > 0")
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    items = (benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("item_text"))
             .where("item_id is not null and length(item_text) > 0").distinct()
             .select("item_id", _tokens("item_text").alias("tokens")).where(F.size("tokens") >= 2 * short - 1))
    items = store(items, "leak-tokens")
    items = _forms(items.union(_with_names(items)).distinct())
    items = store(items.withColumn("m", F.size("tokens")).withColumn("version", F.xxhash64("tokens")), "leak-items")
    hits = store(_hits(rows, items).distinct(), "leak-hits")
    held = hits.select("row_id", "text_hash").distinct()
    texts = store(rows.join(held, ["row_id", "text_hash"]).dropDuplicates(["row_id", "text_hash"])
                  .select("row_id", "text_hash", _tokens("text").alias("tokens")), "leak-texts")
    # an alignment is a shift with those near it: words put in or left out move what follows
    # (items that must agree wholly have none)
    reach = F.when(F.col("m") < 2 * k - 1, 0).otherwise(F.floor(F.col("m") / 4)).cast("int")
    versions = items.select("item_id", "version", F.col("tokens").alias("marked"), "m")
    agreed = (hits.join(texts, ["row_id", "text_hash"]).join(versions, "item_id")
              .withColumn("skip", F.greatest(F.lit(0), -F.col("shift")))
              .withColumn("part", F.slice("tokens", F.greatest(F.lit(0), F.col("shift")) + 1, F.greatest(F.lit(0), F.col("m") - F.col("skip"))))
              .withColumn("own", F.slice("marked", F.col("skip") + 1, F.size("part"))))
    both = F.arrays_zip(F.transform("own", lambda t, j: j + F.col("skip")).alias("j"), F.col("own").alias("i"), F.col("part").alias("d"))
    number = lambda t: _first(t).isin([NUMBER, UNIT])
    # a name of the item is a slot for any word, since capitals may be missing in the document
    fits = lambda x: ((_value(x["i"]) == _value(x["d"])) | (number(x["i"]) & (_first(x["i"]) == _first(x["d"])))
                      | ((_first(x["i"]) == NAME) & ~number(x["d"])))
    key = ["row_id", "text_hash", "item_id", "version", "m"]
    agreed = store(agreed.select(*key, "shift", reach.alias("reach"), F.filter(both, fits).alias("x")).where(F.size("x") > 0), "leak-agreed")
    anchors = agreed.select(*key, F.explode(F.sequence(F.col("shift") - F.col("reach"), F.col("shift") + F.col("reach"))).alias("anchor"), "shift", "x")
    anchors = anchors.join(agreed.select(*key, F.col("shift").alias("anchor")), [*key, "anchor"])
    each = anchors.select(*key, "anchor", "shift", F.explode("x").alias("x")).select(
        *key, "anchor", F.col("x.j").alias("j"), F.col("x.i").alias("i"), _value(F.col("x.d")).alias("d"),
        F.abs(F.col("shift") - F.col("anchor")).alias("off")).withColumn("same", _value(F.col("i")) == F.col("d"))
    # one aligned token for each token of the item: an equal one if there is any, else the nearest
    each = each.groupBy(*key, "anchor", "j").agg(F.min_by(F.struct("i", "d", "same"), F.struct(~F.col("same"), "off", "d")).alias("x"))
    each = each.select(*key, "anchor", "x.*").withColumn("slot", _first(F.col("i")).isin(_SLOTS))
    per = each.groupBy(*key, "anchor").agg(
        F.count("*").alias("template"), F.count_if("same").alias("exact"), F.count_if(F.col("slot") & ~F.col("same")).alias("other"),
        F.size(F.collect_set(F.when(F.col("slot"), F.struct("i", "d")))).alias("maps"),
        F.size(F.collect_set(F.when(F.col("slot"), F.col("i")))).alias("from_values"),
        F.size(F.collect_set(F.when(F.col("slot"), F.struct(_first(F.col("i")).alias("t"), "d")))).alias("to_values"))
    consistent = (F.col("maps") == F.col("from_values")) & (F.col("maps") == F.col("to_values"))
    brief = F.col("m") < 2 * k - 1
    # slots with other values count against the equal tokens; if they map inconsistently, so much more must be equal
    exact = F.when(brief, F.col("exact") == F.col("m")).otherwise(
        F.col("exact") - F.col("other") >= F.when(consistent, EXACT_SHARE).otherwise(TEMPLATE_SHARE) * F.col("m"))
    template = consistent & (F.col("template") >= F.when(brief, F.col("m")).otherwise(TEMPLATE_SHARE * F.col("m")))
    other_values = template & (F.col("other") > 0)
    found = per.select("row_id", "item_id", "m", F.when(other_values, "reparameterised").when(exact, "exact").alias("kind"),
                       F.when(other_values, F.col("template")).otherwise(F.col("exact")).alias("matched")).where("kind is not null")
    best = found.groupBy("row_id", "item_id").agg(F.min_by(F.struct("kind", "matched", "m"), F.struct("kind", -F.col("matched"), "m")).alias("b"))
    return best.select(F.col("row_id").alias("doc_id"), "item_id", "b.kind", F.col("b.matched").cast("long").alias("matched"),
                       F.col("b.m").cast("long").alias("item_tokens"), (F.col("b.matched") / F.col("b.m")).alias("share"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; all columns and
    clean rows (null ids too) stay as they are."""
    drop = store(leaks(docs, benchmark, id_col, text_col).select(F.col("doc_id").alias("__leak")).distinct(), "leak-ids")
    return docs.join(drop, F.col(id_col) == F.col("__leak"), "left_anti")
