"""Personal data by base patterns and bootstrapped contextual extraction, in built-in functions only.

Base entities are found by regular expressions. Those, and strings with the shape of a key, are the seeds. Every mention of a seed, of a
labelled value or of a token with digits has contexts: the label and connector before it (as in `token = "`) or the two words before
it, and the two words behind it. These contexts are the lexical patterns. Patterns and values make a bipartite graph, whose scores
Spark passes back and forth a few times; patterns of high confidence, most of whose values are seeds or believed, then discover
values that no base pattern knows, and a value that is believed is one wherever it stands.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermesh.session import cut, gathered

KINDS = ("email", "ip", "card", "phone")
DISCOVERED = "secret"

# The base patterns, written so that no position is tried twice and long runs need no stack: an address begins where a run of its
# characters does or where the last match ended, and a card number is a whole run of 16 to 19 digits.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Whether a text can hold a kind at all; cheap, and true wherever the pattern can match with a valid value.
MAY_HOLD = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: F.rlike(t, F.lit(r"[0-9]\.[0-9]++\.[0-9]")),
    "card": lambda t: F.rlike(t, F.lit(r"[0-9](?:[\x20-]?[0-9]){15}")),
    "phone": lambda t: F.rlike(t, F.lit(r"\+[0-9]")),
}
#: A label and its connector, at the end of what stands before a value.
LABEL = r"([A-Za-z][A-Za-z_-]{1,30}+)(\x20?[:=#]\x20?)[\x22']?$"
#: A labelled value of 4 characters or more up to its delimiter, and a token of 6 characters or more that holds a digit.
LABELLED = r"(?<=[A-Za-z_-]\x20?[:=#]\x20?[\x22']?)[^\s\x22',;<>]{4,}+"
TOKEN = r"(?<![^\s\x22',;<>:=#(])(?=[^\s\x22',;<>:=#0-9]*+[0-9])[^\s\x22',;<>:=#]{6,}+"
MENTION = "|".join(f"(?:{p})" for p in (PATTERNS["email"].replace(r"|\G", ""), PATTERNS["phone"], PATTERNS["ip"], PATTERNS["card"], LABELLED, TOKEN))
MAY_MENTION = r"[0-9]|[A-Za-z_-]\x20?[:=#]"
#: Two words behind a value, and two before it.
BEHIND, BEFORE = r"^[^\s\w]*\s+(\S+\s+\S+)\s", r"(?:^|\s)(\S+\s+\S+)\s+[\x22'(]?$"
#: Characters beside a value that are looked at.
REACH = 60
#: Shape of values that are seeds besides base entities: hexadecimal strings and access keys.
KEY_SHAPE = r"^(?:(?=[0-9a-f]*[0-9])(?=[0-9a-f]*[a-f])[0-9a-f]{16,}|AKIA[0-9A-Z]{12,}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9]{20,})$"
ROUNDS = 3
LEAST_CONFIDENCE = 0.6
LEAST_SUPPORT = 3
#: Belief from which a value is one wherever it stands: a seed's, or that of two patterns of high confidence.
LEAST_BELIEF = 0.85
#: Parts that the rows of a pattern or value are joined in.
SALTS = 16
#: Rows of a partition of the tables of patterns and values.
GRAPH_ROWS = 200_000

_EMPTY = "array<struct<kind:string,start:int,end:int,value:string>>"


def _no_spans() -> Column:
    return F.array().cast(_EMPTY)


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """The running totals of an array under an associative operation, by doubling steps: n log n, where appending would copy n * n."""
    steps = F.slice(F.array(*(F.lit(1 << i) for i in range(31))), F.lit(1), F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)))).cast("int"))
    return F.aggregate(steps, values, lambda acc, d: F.transform(acc, lambda x, i: F.when(i >= d, op(F.get(acc, i - d), x)).otherwise(x)))


def _ends(pieces: Column, values: Column) -> Column:
    """Where each match ends. pieces: what stands between the matches; values: the matches. A lambda would evaluate another column's expression for each element, so both go in as arguments."""
    return running(F.zip_with(F.slice(pieces, F.lit(1), F.size(values)), values, lambda p, v: F.length(p) + F.length(v)), lambda a, b: a + b)


def _spans(text: Column, pattern: str, kind: str) -> Column:
    """Spans of the pattern's leftmost non-overlapping matches: the text is cut at them, and lengths add up."""
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    ends = _ends(F.split(text, pattern), values)
    return F.zip_with(values, ends, lambda v, e: F.struct(F.lit(kind).alias("kind"), (e - F.length(v)).alias("start"), e.alias("end"), v.alias("value")))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    doubled = F.transform(F.split(F.reverse(number), ""), lambda d, i: F.when(i % 2 == 1, (d.cast("int") * 2) % 10 + F.floor(d.cast("int") * 2 / 10).cast("int")).otherwise(d.cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return ~F.exists(F.split(value, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) > 3) | (F.lpad(F.right(p, F.lit(3)), 3, "0") > "255"))
    if kind == "card":
        return F.length(digits(value)).between(16, 19) & luhn(digits(value))
    if kind == "phone":
        return F.length(digits(value)).between(8, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """All base spans by kind as listed, then start."""
    def of(kind: str) -> Column:
        return F.when(MAY_HOLD[kind](text), F.filter(_spans(text, PATTERNS[kind], kind), lambda s: _valid(kind, s["value"]))).otherwise(_no_spans())

    return F.concat(*map(of, KINDS))


def plain(text: Column) -> Column:
    """The text, null as empty."""
    return F.coalesce(text.cast("string"), F.lit(""))


def seed_kind(value: Column) -> Column:
    """The base kind of a whole value, or the name of the key shape; null for none."""
    whole = {"email": r"^[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++$", "ip": r"^[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++$", "card": r"^[0-9](?:[\x20-]?[0-9]){15,18}$", "phone": r"^\+[0-9][\x20().0-9-]+[0-9]$"}
    out = None
    for kind, pattern in whole.items():
        fits = F.rlike(value, F.lit(pattern)) & _valid(kind, value)
        out = F.when(fits, kind) if out is None else out.when(fits, kind)
    return out.when(F.rlike(value, F.lit(KEY_SHAPE)), DISCOVERED)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def contexts(before: Column, behind: Column) -> Column:
    """The patterns that a mention supports: its label with the connector, or the two words before it; and the two words behind it. Digits count as 0."""
    label = F.lower(F.regexp_replace(F.regexp_extract(before, LABEL, 0), r"[\x22']$", ""))
    tidy = lambda c: F.lower(F.regexp_replace(F.regexp_replace(c, r"[0-9]", "0"), r"\s+", " "))
    words, after = tidy(F.regexp_extract(before, BEFORE, 1)), tidy(F.regexp_extract(behind, BEHIND, 1))
    left = F.when(label != "", F.concat(F.lit("= "), label)).when(words != "", F.concat(F.lit("< "), words))
    return F.array_compact(F.array(left, F.when(after != "", F.concat(F.lit("> "), after))))


def mentions(rows: DataFrame) -> DataFrame:
    """(doc_id, tag, value, start, end, patterns, kind): each seed, labelled value and token with a digit. rows: doc_id, tag, text."""
    pieces, values = F.split("text", MENTION), F.regexp_extract_all("text", F.lit(MENTION), F.lit(0))
    cut_up = rows.filter(F.rlike("text", F.lit(MAY_MENTION))).select("doc_id", "tag", pieces.alias("pieces"), values.alias("found")).filter(F.size("found") > 0)
    parts = {
        "value": F.col("found"),
        "end": _ends(F.col("pieces"), F.col("found")),
        "before": F.transform("pieces", lambda p: F.right(p, F.lit(REACH))),
        "behind": F.slice(F.transform("pieces", lambda p: F.left(p, F.lit(REACH))), F.lit(2), F.size("found")),
    }
    one = cut_up.select("doc_id", "tag", F.explode(F.arrays_zip(*(c.alias(n) for n, c in parts.items()))).alias("m")).select("doc_id", "tag", "m.*").filter("value is not null")
    return one.select("doc_id", "tag", "value", (F.col("end") - F.length("value")).alias("start"), "end", contexts(F.col("before"), F.col("behind")).alias("patterns"), seed_kind(F.col("value")).alias("kind"))


def _by(rows: DataFrame, known: DataFrame, key: str, other: str) -> DataFrame:
    """rows with the columns that known has for their key. A key's rows are dealt out by `other`, so a frequent one isn't one task's."""
    salt = F.pmod(F.xxhash64(other), F.lit(SALTS)).cast("int")
    known = known.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # never broadcast: what gathered() wrote is estimated by its compressed size, without the salts
    return rows.withColumn("_salt", salt).join(known.hint("merge"), [key, "_salt"]).drop("_salt")


def scored_graph(found: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(pattern, confidence) of the patterns whose values are mostly seeds or believed, and (value, belief) of the values that are believed for themselves.

    A pattern with fewer values than LEAST_SUPPORT can't become confident and is left out from the start.
    """
    edges = found.select(F.explode("patterns").alias("pattern"), "value", F.col("kind").isNotNull().cast("double").alias("seed"))
    graph = gathered(edges.groupBy("pattern", "value").agg(F.max("seed").alias("seed")), GRAPH_ROWS)
    often = graph.groupBy("pattern").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_SUPPORT).select("pattern")
    graph = gathered(_by(graph, often, "pattern", "value"), GRAPH_ROWS)
    score = graph.withColumn("belief", F.col("seed"))
    values = patterns = None
    for _ in range(rounds):
        patterns = score.groupBy("pattern").agg((F.sum("belief") / (F.count("*") + 1)).alias("confidence"), F.count_if(F.col("belief") >= 0.5).alias("support"))
        patterns = gathered(patterns.select("pattern", F.when(F.col("support") >= LEAST_SUPPORT, F.col("confidence")).otherwise(0.0).alias("confidence")), GRAPH_ROWS)
        # a value that several patterns hold is believed as far as these are: 1 - prod(1 - confidence)
        doubt = F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence") * 0.9, F.lit(1e-9)))))
        values = gathered(_by(graph, patterns, "pattern", "value").groupBy("value").agg(F.greatest(F.max("seed"), (1 - doubt) * 0.9).alias("belief")), GRAPH_ROWS)
        score = gathered(_by(graph, values, "value", "pattern"), GRAPH_ROWS)
    return patterns.filter(F.col("confidence") >= LEAST_CONFIDENCE), values.filter(F.col("belief") >= LEAST_BELIEF)


def discovered(docs: DataFrame) -> DataFrame:
    """(doc_id, tag, more): spans beside the base ones, by document and text: key shapes, and what confident patterns or believed values show."""
    rows = docs.select("doc_id", F.xxhash64(plain(F.col("text"))).alias("tag"), plain(F.col("text")).alias("text")).filter("doc_id is not null")
    found = cut(mentions(rows))
    patterns, values = scored_graph(found)
    place = ["doc_id", "tag", "start", "end", "value"]
    open_ones = found.filter("kind is null")  # base entities are reported by themselves
    shaped = found.filter(F.col("kind") == DISCOVERED).select(*place)
    by_pattern = _by(open_ones.select(*place, F.explode("patterns").alias("pattern")), patterns, "pattern", "value").select(*place)
    by_value = _by(open_ones, values, "value", "start").select(*place)
    kept = shaped.union(by_pattern).union(by_value).distinct()
    return kept.groupBy("doc_id", "tag").agg(F.array_sort(F.collect_list(F.struct(F.lit(DISCOVERED).alias("kind"), "start", "end", "value"))).alias("more"))


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and n_discovered of each row of docs.

    A null text counts as empty: no spans. Spans are in code points, end exclusive. Rows that repeat a doc_id and a text
    get equal values; a row with a null doc_id gets base spans only. Other columns are left out.
    """
    base = docs.select("doc_id", plain(F.col("text")).alias("text")).select("doc_id", F.xxhash64("text").alias("tag"), base_spans(F.col("text")).alias("base"))
    all_found = base.join(discovered(docs), ["doc_id", "tag"], "left")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    more = F.coalesce("more", _no_spans())
    return all_found.select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", more)).alias("spans"), F.size(more).cast("long").alias("n_discovered"))


#: Code points of the blocks that a text is cut into, so that a piece is taken without walking the text from its begin.
BLOCK = 1_024


def masked(text: Column, spans: Column) -> Column:
    """The text with each span, or run of overlapping spans, replaced by its first kind in brackets."""
    ordered = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))
    reach = F.struct(ordered.alias("s"), running(F.transform(ordered, lambda s: s["end"]), F.greatest).alias("to"), F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)).alias("blocks"))

    def piece(x: Column, a: Column, b: Column) -> Column:
        first, last = F.floor(a / BLOCK).cast("int"), F.floor((b - 1) / BLOCK).cast("int")
        own = F.array_join(F.slice(x["blocks"], first + 1, last - first + 1), "")
        return F.when(b > a, F.substr(own, a - first * BLOCK + 1, b - a)).otherwise("")

    def put_together(x: Column) -> Column:
        # a run begins where a span starts behind all ends before it; its end is known where the next one begins
        begins = F.filter(F.transform(x["s"], lambda s, i: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), F.when(i > 0, F.get(x["to"], i - 1)).otherwise(0).alias("before"), (i == 0).alias("first"))), lambda r: r["first"] | (r["start"] >= r["before"]))
        parts = F.transform(begins, lambda r: F.concat(piece(x, r["before"], r["start"]), F.lit("["), F.upper(r["kind"]), F.lit("]")))
        return F.concat(F.array_join(parts, ""), piece(x, F.element_at(x["to"], -1), F.length(text)))

    return F.when(F.size(spans) > 0, F.element_at(F.transform(F.array(reach), put_together), 1)).otherwise(text)


def mask_pii(docs: DataFrame) -> DataFrame:
    """docs with every span masked in text and n_chars (where it exists) counted anew; null texts stay null, other columns as they are."""
    more = discovered(docs).select(F.col("doc_id").alias("_id"), F.col("tag").alias("_own"), "more")
    rows = docs.select(F.struct("*").alias("_row"), F.xxhash64(plain(F.col("text"))).alias("_tag"))
    rows = rows.join(more, (F.col("_row.doc_id") == F.col("_id")) & (F.col("_tag") == F.col("_own")), "left")
    text = F.col("_row.text").cast("string")
    rows = rows.withColumn("_spans", F.concat(base_spans(plain(text)), F.coalesce("more", _no_spans())))
    found = F.size("_spans") > 0
    rows = rows.withColumn("_masked", F.when(found, masked(text, F.col("_spans"))).otherwise(text))

    def column(f) -> Column:
        own = F.col(f"_row.`{f.name}`")
        if f.name == "text":
            return F.col("_masked").alias("text")
        if f.name == "n_chars":
            return F.when(found, F.length("_masked").cast(f.dataType)).otherwise(own).alias("n_chars")
        return own.alias(f.name)

    return rows.select(*map(column, docs.schema.fields))
