"""Personal data: base kinds by pattern, and more by bootstrapped context, on DataFrame functions only.

The base kinds are matched with expressions that never backtrack over a run twice
(possessive, and anchored to the start of a run), so very long tokens stay linear.
Places come from the pieces between the matches: their lengths, summed.

Bootstrapping: every token with a digit or an @, and every run of such tokens with
only space between, is an instance; the words beside it are its lexical patterns, a
side without a word has none. Those inside base spans are seeds of their kind. In
each round a pattern's score for a kind is the mean score of its distinct
instances, and an instance's score is that some accepted pattern is right about it;
seeds keep score one. Tokens outside the base spans that end with a high score are
added as spans of the kind "like_<kind>".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, *(f"like_{k}" for k in KINDS))
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TOKEN = r"(?<![^\x20\x09-\x0D])[^0-9@\x20\x09-\x0D]*+[0-9@][^\x20\x09-\x0D]*+"
#: A pattern counts with this many distinct instances and this score; an instance is added from this score.
SUPPORT, PATTERN_SCORE, INSTANCE_SCORE, ROUNDS = 5, 0.8, 0.8, 3
BLOCK = 64
#: Code points of a block of text.
PART = 2048


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def value(i):
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        parts = F.transform(F.split(m, "\\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.substring(p, 1, 4).cast("int") <= 255))
    if kind == "card":
        return F.length(digits).between(12, 19) & _luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _gate(kind: str) -> Column:
    has = F.col("text").contains("@") if kind == "email" else F.col("text").contains("+") if kind == "phone" else F.lit(True)
    return has & (F.lit(True) if kind == "email" else F.col("text").rlike("[0-9]"))


def _located(df: DataFrame, name: str, pattern: str, gate: Column) -> DataFrame:
    """df with <name>_m, the matches, <name>_p, the pieces around them, and <name>_s, where they start in code points.

    The lengths are summed in blocks, so that a text with very many matches takes little more than linear time.
    """
    none = F.array().cast("array<string>")
    df = df.withColumn(f"{name}_m", F.when(gate, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(none))
    m = F.col(f"{name}_m")
    df = df.withColumn(f"{name}_p", F.when(F.size(m) > 0, F.split("text", pattern, -1)).otherwise(none))
    df = df.withColumn("_w", F.zip_with(F.transform(m, lambda x: F.length(x)), F.transform(F.slice(f"{name}_p", 1, F.size(m)), lambda x: F.length(x)), lambda a, b: a + b))
    blocks = F.when(F.size("_w") > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size("_w") - 1) / BLOCK).cast("int")), lambda b: F.aggregate(F.slice("_w", b * BLOCK + 1, BLOCK), F.lit(0), lambda a, x: a + x))).otherwise(F.array().cast("array<int>"))
    df = df.withColumn("_b", blocks)
    df = df.withColumn("_c", F.transform("_b", lambda x, i: F.aggregate(F.slice("_b", 1, i), F.lit(0), lambda a, y: a + y)))
    # every array is named at least twice, so that no projection is folded into a lambda and computed again per element
    start = F.transform("_w", lambda w, i: F.when(F.size("_c") > 0, F.get("_c", F.floor(i / BLOCK).cast("int"))) + F.aggregate(F.slice("_w", F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK + 1), F.lit(0), lambda a, y: a + y) - F.length(F.get(m, i)))
    return df.withColumn(f"{name}_s", start).drop("_w", "_b", "_c")


def _spans(kind: str) -> Column:
    """Valid matches of a kind as (start, kind number, end)."""
    m, s = F.col(f"{kind}_m"), F.col(f"{kind}_s")
    all_ = F.zip_with(s, m, lambda a, x: F.struct(a.alias("start"), F.lit(KINDS.index(kind)).alias("k"), (a + F.length(x)).alias("end"), x.alias("m")))
    return F.transform(F.filter(all_, lambda x: _valid(kind, x["m"])), lambda x: F.struct(x["start"].alias("start"), x["k"].alias("k"), x["end"].alias("end")))


def with_base_spans(df: DataFrame) -> DataFrame:
    """df(text, not null) with base: the base spans by start and kind."""
    for kind in KINDS:
        df = _located(df, kind, PATTERNS[kind], _gate(kind)).withColumn(f"{kind}_v", _spans(kind)).drop(f"{kind}_m", f"{kind}_p", f"{kind}_s")
    return df.withColumn("base", F.sort_array(F.concat(*[f"{k}_v" for k in KINDS])))


def _over(kind: str, a: Column, b: Column) -> Column:
    """The first span of a kind that overlaps a..b, or null, by halving: spans of one kind are in order and don't overlap."""
    v = f"{kind}_v"
    steps = F.slice(F.sequence(F.lit(0), F.ceil(F.log2(F.size(v) + F.lit(1))).cast("int")), 1, F.ceil(F.log2(F.size(v) + F.lit(1))).cast("int"))
    half = lambda x: F.floor((x["lo"] + x["hi"]) / 2).cast("int")

    def step(x, _):
        ends_after = F.get(v, half(x))["end"] > a
        return F.when(x["lo"] >= x["hi"], x).otherwise(F.struct(F.when(ends_after, x["lo"]).otherwise(half(x) + 1).alias("lo"), F.when(ends_after, half(x)).otherwise(x["hi"]).alias("hi")))

    found = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(v).alias("hi")), step, lambda x: F.get(v, x["lo"]))
    return F.when(F.size(v) > 0, F.filter(F.array(found), lambda x: x["start"] < b)).otherwise(F.array().cast("array<struct<start:int,k:int,end:int>>"))


def _word(piece: Column, last: bool) -> Column:
    flat = F.btrim(F.translate(piece, "\t\n\x0b\x0c\r", "     "), F.lit(" "))
    return F.lower(F.substring_index(flat, " ", -1 if last else 1))


def _with_tokens(df: DataFrame) -> DataFrame:
    """df(text, base) with tokens: instances with their place, patterns and seed kind (-1 for none).

    An instance is a run of neighbouring tokens of one base span, or of none. The tokens
    of a longer run outside the base spans follow on their own, without patterns, since
    one of them may be known from elsewhere.
    """
    gate = F.col("text").rlike("[0-9@]")
    df = _located(df, "t", TOKEN, gate)
    span = lambda a, b: F.array_min(F.concat(*[_over(k, a, b) for k in KINDS]))
    single = F.transform("t_m", lambda m, i: F.struct(
        F.get("t_s", i).alias("start"), (F.get("t_s", i) + F.length(m)).alias("end"), F.lower(F.btrim(m, F.lit(".,;:!?()[]\"'"))).alias("instance"),
        _word(F.get("t_p", i), True).alias("left"), _word(F.get("t_p", i + 1), False).alias("right"), span(F.get("t_s", i), F.get("t_s", i) + F.length(m)).alias("span")))
    df = df.withColumn("_t", single).drop("t_m", "t_p", "t_s")
    # a token goes on with the one before it if only space is between them and both are in one base span, or neither in any
    same = lambda a, b: (a["right"] == "") & a["span"].eqNullSafe(b["span"])
    df = df.withColumn("_on", F.transform("_t", lambda t, i: (i > 0) & F.coalesce(same(F.get("_t", i - 1), t), F.lit(False))))
    df = df.withColumn("_a", F.filter(F.transform("_on", lambda on, i: F.when(~on, i)), lambda i: i.isNotNull()))
    side = lambda word, i: F.when((word != "") | (i < 0), word).otherwise(F.coalesce(F.get("_t", i)["instance"], F.lit("")))
    seed = lambda t: F.coalesce(t["span"]["k"], F.lit(-1)).alias("seed")

    def run(a, z):
        first, last = F.get("_t", a), F.get("_t", z)
        return F.struct(
            first["start"].alias("start"), last["end"].alias("end"), F.array_join(F.transform(F.slice("_t", a + 1, z - a + 1), lambda t: t["instance"]), " ").alias("instance"),
            side(first["left"], a - 1).alias("left"), side(last["right"], z + 1).alias("right"), seed(first))

    runs = F.transform("_a", lambda a, i: run(a, F.coalesce(F.get("_a", i + 1), F.size("_t")) - 1))
    inner = F.filter("_t", lambda t, i: t["span"].isNull() & (F.get("_on", i) | F.coalesce(F.get("_on", i + 1), F.lit(False))))
    inner = F.transform(inner, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), t["instance"].alias("instance"), F.lit("").alias("left"), F.lit("").alias("right"), seed(t)))
    return df.withColumn("tokens", F.concat(runs, inner)).drop("_t", "_on", "_a")


def discovered(tokens: DataFrame) -> DataFrame:
    """(instance, k, score) of unseen instances, from tokens(instance, left, right, seed); iterated scoring of the pattern-instance graph."""
    left, right = F.col("left") != "", F.col("right") != ""
    sides = F.when(left, F.concat(F.lit("L "), "left")), F.when(right, F.concat(F.lit("R "), "right")), F.when(left & right, F.concat(F.lit("B "), "left", F.lit(" "), "right"))
    pattern = F.explode(F.array_compact(F.array(*sides)))
    graph = written(tokens.filter("instance <> ''").select("instance", "seed", pattern.alias("pattern")).groupBy("pattern", "instance").agg(F.max("seed").alias("seed")), "graph")
    sizes = graph.groupBy("pattern").agg(F.count("*").alias("n")).filter(F.col("n") >= SUPPORT)
    scored = graph.filter("seed >= 0").select("instance", F.col("seed").alias("k"), F.lit(1.0).alias("score")).distinct()
    seeds, found = scored, None
    for _ in range(ROUNDS):
        patterns = graph.join(scored, "instance").groupBy("pattern", "k").agg(F.sum("score").alias("s")).join(sizes, "pattern").select("pattern", "k", (F.col("s") / F.col("n")).alias("p")).filter(F.col("p") >= PATTERN_SCORE)
        miss = F.sum(F.log(F.greatest(1 - F.col("p"), F.lit(1e-9))))
        found = graph.join(patterns, "pattern").join(seeds.select("instance"), "instance", "left_anti").groupBy("instance", "k").agg((1 - F.exp(miss)).alias("score")).filter(F.col("score") >= INSTANCE_SCORE)
        found = written(found, "instances")
        scored = seeds.unionAll(found)
    return found


def _narrow(docs: DataFrame) -> DataFrame:
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.coalesce("text", F.lit("")).alias("text"))
    return written(_with_tokens(with_base_spans(texts)).drop("text", *[f"{k}_v" for k in KINDS]), "personal")


def _more(narrow: DataFrame) -> DataFrame:
    """(doc_id, text_hash, more): the spans that context adds, of the rows that have any."""
    tokens = narrow.select("doc_id", "text_hash", F.explode("tokens").alias("t")).select("doc_id", "text_hash", "t.*")
    best = discovered(tokens).groupBy("instance").agg(F.max(F.struct("score", (-F.col("k")).alias("m"))).alias("x")).select("instance", (-F.col("x.m")).alias("k"))
    hits = tokens.filter("seed < 0").join(best, "instance").select("doc_id", "text_hash", F.struct("start", (F.col("k") + len(KINDS)).alias("k"), "end").alias("x"))
    return written(hits.groupBy("doc_id", "text_hash").agg(F.collect_set("x").alias("more")), "more")


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, ALL_KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def _with_more(rows: DataFrame, more: DataFrame) -> DataFrame:
    """rows(doc_id, text_hash, ...) with more; Spark broadcasts `more` if its files are below the threshold, and shuffles otherwise."""
    m = more.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "more")
    none = F.array().cast("array<struct<start:int,k:int,end:int>>")
    return rows.join(m, rows["doc_id"].eqNullSafe(m["_id"]) & (rows["text_hash"] == m["_hash"]), "left").drop("_id", "_hash").withColumn("more", F.coalesce("more", none))


def _count(k: int) -> Column:
    return F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    A null text counts as empty: no spans, the digest of the empty string. Null and
    repeated ids come out as they came in; other columns are ignored; an empty table
    gives an empty one. Instances meet in groupings that combine before the shuffle.
    """
    narrow = _narrow(docs)
    rows = _with_more(narrow.select("doc_id", "text_hash", "base"), _more(narrow))
    counts = [_count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return rows.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.sort_array(F.concat("base", "more"))).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span of its texts replaced by its kind in angle brackets, and n_chars, where there is one, made to fit.

    Overlapping spans become one, named after the first. Null texts, texts without spans,
    and all other columns stay as they are, whatever their names; repeated rows come out
    as often as they came in; an empty table gives an empty one. The work on a text is
    linear in its length and its spans: ends are carried on and text is cut by blocks.
    """
    more = _more(_narrow(docs))
    packed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.coalesce("text", F.lit("")).alias("text"), F.struct(*[docs[c] for c in docs.columns]).alias("whole"))
    rows = _with_more(with_base_spans(packed).drop(*[f"{k}_v" for k in KINDS]), more).withColumn("all", F.sort_array(F.concat("base", "more")))
    n = F.size("all")
    # the largest end so far, by blocks
    blocks = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda b: F.array_max(F.transform(F.slice("all", b * BLOCK + 1, BLOCK), lambda x: x["end"])))).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("block_end", blocks)
    rows = rows.withColumn("before", F.transform("block_end", lambda x, i: F.when(i > 0, F.array_max(F.slice("block_end", 1, i))).otherwise(F.lit(0))))
    at = lambda i: F.floor(i / BLOCK).cast("int")
    # as above, `before` is named twice so that it isn't computed again per span
    rows = rows.withColumn("reach", F.transform("all", lambda x, i: F.greatest(F.when(F.size("before") > 0, F.get("before", at(i))), F.array_max(F.transform(F.slice("all", at(i) * BLOCK + 1, i % BLOCK + 1), lambda y: y["end"])))))
    rows = rows.withColumn("first", F.filter(F.transform("all", lambda x, i: F.when((i == 0) | (x["start"] >= F.get("reach", i - 1)), i)), lambda i: i.isNotNull()))
    rows = rows.withColumn("cut", F.transform("first", lambda f, i: F.struct(F.get("all", f)["start"].alias("start"), F.get("all", f)["k"].alias("k"), F.get("reach", F.coalesce(F.get("first", i + 1), F.size("reach")) - 1).alias("end"))))
    # pieces of the text come from blocks of it, since to count code points from the start for each of many spans isn't linear
    rows = rows.withColumn("part", F.when(F.size("cut") > 0, F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PART}}}"), F.lit(0))).otherwise(F.array().cast("array<string>")))

    def piece(a, b):
        whole = F.array_join(F.slice("part", F.floor(a / PART).cast("int") + 1, F.floor(b / PART).cast("int") - F.floor(a / PART).cast("int") + 1), "")
        return F.substring(whole, a % PART + 1, b - a)

    names = F.array(*[F.lit(f"<{k.upper()}>") for k in ALL_KINDS])
    before = lambda i: F.when(i > 0, F.get("cut", i - 1)["end"]).otherwise(F.lit(0))
    body = F.array_join(F.transform("cut", lambda x, i: F.concat(piece(before(i), x["start"]), F.get(names, x["k"]))), "")
    end = F.get("cut", F.size("cut") - 1)["end"]
    new = F.when(F.size("cut") > 0, F.concat(body, piece(end, F.length("text")))).otherwise(F.col("whole")["text"])
    rows = rows.select("whole", new.alias("new"), F.size("cut").alias("n"))
    out = []
    for c in docs.columns:
        old = F.col("whole")[c]
        out.append(F.col("new").alias(c) if c == "text" else F.when(F.col("n") > 0, F.length("new")).otherwise(old).cast(dict(docs.dtypes)[c]).alias(c) if c == "n_chars" else old.alias(c))
    return rows.select(*out)
