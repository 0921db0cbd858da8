"""Personal data: base patterns and bootstrapped contextual extraction, in DataFrame functions only.

Base spans come from four fixed formats.  They are the seeds, and so are long
runs of hexadecimal digits as seeds of secrets.  Each occurrence gives lexical
patterns (the word before it with the punctuation between, the word after it,
both), and so do all other identifier-like strings: words with a digit or an at
sign, of any length, and groups of digits joined by single spaces, hyphens, dots,
slashes or brackets.  Patterns and values form a bipartite graph with counts on
its edges.  In each round a pattern's confidence for a kind is the share of its
occurrences whose value is believed to be of that kind, and a value's belief is
the noisy-or of its patterns' confidences; seeds stay at 1.  Confidences can only
grow, and rounds go on until no trusted pattern changes.  Values that patterns of
high confidence and enough distinct seeds reach become spans of that kind; the
base spans stay.  A seed of secrets is a span only beside a trusted pattern, as
its format alone tells too little.

Null and empty texts have no spans.  Offsets are code points.  Repeated rows
each give a row, and each counts in the graph.  Found spans never overlap base
ones or each other.  An empty table gives an empty result; other columns are not
read, and their names do not matter.  Very long texts are searched whole: no step
is quadratic in a text's length or matches, as running sums go over pieces of
about the square root of their number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, quoted, table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
CONFIDENCE, SEEDS, PRIOR = 0.8, 5, 1.0

# The contract's patterns.  A look-behind or \G (the end of the last match)
# allows only starts that a leftmost search could find first, and possessive
# repeats take what greedy ones would keep, so long runs are read once.
_WORD = "A-Za-z0-9._%+-"
_EMAIL = rf"(?:(?<![{_WORD}])|\G)[{_WORD}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: Maximal chains of digits with single spaces or hyphens, 12 to 19 digits long.
_CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_BYTE = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$"
_RUN = r"\s\"'<>|,;="  # what ends a word here
#: Groups of digits, or a word with a digit or an at sign.
_CANDIDATE = rf"(?<![^{_RUN}])(?:[(]?[0-9]++[)]?(?:[ ./-][(]?[0-9]++[)]?)++(?![\p{{L}}\p{{N}}@])|(?=[^{_RUN}0-9@]*+[0-9@])[^{_RUN}]++)"
#: 32 or more hexadecimal digits, both letters and figures.
_HEX = r"^(?=[0-9]*+[A-Fa-f])(?=[A-Fa-f]*+[0-9])[0-9A-Fa-f]{32,}+$"
_OUTER = r"(?<![^\p{L}\p{N}])[^\p{L}\p{N}]++$"  # what follows the last letter or digit

_SPAN = "struct<s:int,e:int,v:string,l:string,r:string>"
_TAGGED = "struct<s:int,k:int,e:int,v:string,l:string,r:string>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _pieces(items: Column) -> Column:
    """A non-empty array in pieces of about the square root of its size."""
    return _let(F.ceil(F.sqrt(F.size(items))).cast("int"), lambda k: F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / k).cast("int")), lambda i: F.slice(items, i * k + 1, k)))


def _running(items: Column, zero: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """What step(state, item) emits beside each next state, over an array in order.  Arrays that grow are copied at each step, so they grow within pieces only."""
    none = F.array().cast(f"array<{kind}>")

    def one(acc: Column, x: Column) -> Column:
        state, out = step(acc["at"], x)
        return F.struct(state.alias("at"), F.concat(acc["out"], F.array(out.cast(kind))).alias("out"))

    def piece(acc: Column, part: Column) -> Column:
        done = F.aggregate(part, F.struct(acc["at"].alias("at"), none.alias("out")), one)
        return _let(done, lambda d: F.struct(d["at"].alias("at"), F.concat(acc["out"], F.array(d["out"])).alias("out")))

    zero = F.struct(zero.alias("at"), F.array().cast(f"array<array<{kind}>>").alias("out"))
    return _let(items, lambda x: F.when(F.size(x) > 0, F.aggregate(_pieces(x), zero, piece, lambda acc: F.flatten(acc["out"]))).otherwise(none))


def _before(text: Column) -> Column:
    """The last word of a text in lower case, and the punctuation behind it; empty if there is no word."""
    core = F.regexp_replace(text, _OUTER, "")
    word = F.lower(F.substring_index(F.translate(core, "\t\n\r\x0b\x0c", "     "), " ", -1))
    tail = F.regexp_replace(F.substring(text, F.char_length(core) + 1, F.char_length(text)), r"\s+", "")
    return F.when(F.length(word) == 0, "").otherwise(F.concat_ws(" ", word, F.when(F.length(tail) > 0, tail)))


def _after(text: Column) -> Column:
    """The first word of a text in lower case."""
    return F.lower(F.regexp_extract(text, r"^[^\p{L}\p{N}]*+([\p{L}\p{N}_]++)", 1))


def _matches(text: Column, pattern: str, context: bool) -> Column:
    """Spans (s, e, v, and with context the words l before and r after) of the matches of a pattern: running sums over the pieces between them."""
    none = F.lit(None).cast("string")

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + F.char_length(x["b"])
        end = start + F.char_length(x["m"])
        return end, F.struct(start.alias("s"), end.alias("e"), x["m"].alias("v"), (_before(x["b"]) if context else none).alias("l"), (_after(x["n"]) if context else none).alias("r"))

    def spans(found: Column, between: Column) -> Column:
        zipped = F.arrays_zip(found.alias("m"), F.slice(between, F.lit(1), F.size(found)).alias("b"), F.slice(between, F.lit(2), F.size(found)).alias("n"))
        return _running(zipped, F.lit(0), step, _SPAN)

    each = _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, spans(found, F.split(text, pattern, -1))).otherwise(F.array().cast(f"array<{_SPAN}>")))
    return each


def _candidates(text: Column) -> Column:
    """Identifier-like strings with their context, without the punctuation around them (which joins the word before)."""

    def trimmed(x: Column) -> Column:
        def cut(v: Column) -> Column:
            lead = F.char_length(x["v"]) - F.char_length(F.regexp_replace(x["v"], r"^[^\p{L}\p{N}]++", ""))
            return F.struct(
                (x["s"] + lead).alias("s"), (x["s"] + lead + F.char_length(v)).alias("e"), v.alias("v"),
                F.when((F.length(x["l"]) > 0) & (lead > 0), F.concat(x["l"], F.when(F.instr(x["l"], " ") > 0, "").otherwise(" "), F.substring(x["v"], F.lit(1), lead))).otherwise(x["l"]).alias("l"), x["r"].alias("r"),
            )

        return _let(F.regexp_replace(F.regexp_replace(x["v"], r"^[^\p{L}\p{N}]++", ""), _OUTER, ""), cut)

    return F.filter(F.transform(_matches(text, _CANDIDATE, True), trimmed), lambda x: x["e"] > x["s"])


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    doubled = F.transform(each, lambda c, i: F.when(i % 2 == 0, c.cast("int")).when(c.cast("int") < 5, c.cast("int") * 2).otherwise(c.cast("int") * 2 - 9))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def base_spans(text: Column, kind: str, context: bool = False) -> Column:
    """Spans of one kind in a text."""
    none = F.array().cast(f"array<{_SPAN}>")
    if kind == "email":
        return F.when(F.instr(text, "@") > 0, _matches(text, _EMAIL, context)).otherwise(none)
    if kind == "ip":
        return F.filter(_matches(text, _IP, context), lambda x: x["v"].rlike(_BYTE))
    if kind == "card":
        return F.filter(_matches(text, _CARD, context), lambda x: luhn(F.regexp_replace(x["v"], "[^0-9]", "")))
    return F.when(F.instr(text, "+") > 0, F.filter(_matches(text, _PHONE, context), lambda x: F.char_length(F.regexp_replace(x["v"], "[^0-9]", "")).between(9, 15))).otherwise(none)


def prepared(docs: DataFrame, scratch: Scratch, text_col: str = "text", keep: dict[str, str] | None = None) -> DataFrame:
    """One pass over the texts, written: __rid, the columns that keep names (new name to old) in __kept, base spans of each kind and other candidates with their context."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    keep = keep if keep is not None else {"doc_id": "doc_id"}
    kept = F.struct(*(F.col(quoted(old)).alias(new) for new, old in keep.items()))
    out = docs.select(kept.alias("__kept"), *(base_spans(text, k, True).alias(f"__{k}") for k in BASE), _candidates(text).alias("__other"), F.monotonically_increasing_id().alias("__rid"))
    return scratch.write(out, "prepared")


def _tag(spans: Column, k: Callable[[Column], Column]) -> Column:
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), k(x).alias("k"), x["e"].alias("e"), x["v"].alias("v"), x["l"].alias("l"), x["r"].alias("r")))


def _tagged() -> Column:
    """All base spans of a prepared row as (s, k, e, v, l, r), in order of start, then kind."""
    return F.array_sort(F.concat(*(_tag(F.col(f"__{k}"), lambda x, i=i: F.lit(i)) for i, k in enumerate(BASE))))


def _free(base: Column, other: Column) -> Column:
    """The candidates (k is -1) that overlap no base span: first none that begins before, then, from the end, none that begins later."""
    kind = f"struct<x:{_TAGGED},hit:boolean>"
    is_base = lambda x: x["k"] >= 0
    forward = lambda at, x: (F.when(is_base(x), F.greatest(at, x["e"])).otherwise(at), F.struct(x.alias("x"), (at > x["s"]).alias("hit")))
    back = lambda at, y: (F.when(is_base(y["x"]), y["x"]["s"]).otherwise(at), F.struct(y["x"].alias("x"), (y["hit"] | (at < y["x"]["e"])).alias("hit")))
    once = _running(F.array_sort(F.concat(base, other)), F.lit(0), forward, kind)
    both = _running(F.reverse(once), F.lit(2**31 - 1), back, kind)
    free = F.transform(F.filter(both, lambda y: ~is_base(y["x"]) & ~y["hit"]), lambda y: y["x"])
    return F.when((F.size(base) > 0) & (F.size(other) > 0), free).otherwise(other)


def discovered(rows: DataFrame, scratch: Scratch, confidence: float = CONFIDENCE, seeds: int = SEEDS) -> DataFrame | None:
    """(rid, s, k, e) of the spans that the bootstrapping adds to prepared rows; None if no pattern is trusted."""
    other = _tag(F.col("__other"), lambda x: F.lit(-1))
    with_base = rows.select("__rid", _tagged().alias("__base"), other.alias("__other")).select("__rid", "__base", _free(F.col("__base"), F.col("__other")).alias("__free"))
    seen = with_base.select("__rid", F.explode(F.concat("__base", "__free")).alias("x")).select("__rid", "x.*")
    seen = seen.withColumn("k", F.when((F.col("k") < 0) & F.col("v").rlike(_HEX), KINDS.index("secret")).otherwise(F.col("k")))
    has = lambda c: F.length(c) > 0
    ways = F.array(F.when(has("l"), F.concat(F.lit("<"), "l")), F.when(has("r"), F.concat(F.lit(">"), "r")), F.when(has("l") & has("r"), F.concat(F.lit("="), "l", F.lit(" "), "r")))
    where = scratch.write(seen.select("__rid", "s", "k", "e", "v", F.explode(F.array_compact(ways)).alias("pattern")), "occurrences")
    edges = scratch.write(where.groupBy("pattern", "v", "k").agg(F.count(F.lit(1)).cast("double").alias("n")), "edges")
    total = scratch.write(edges.groupBy("pattern").agg(F.sum("n").alias("total")), "totals")
    belief, before, turn = None, None, 0  # (v, kind, belief) of values that are no seeds
    while True:
        sure = edges.where("k >= 0").select("pattern", "v", F.col("k").alias("kind"), "n", F.lit(1.0).alias("belief"), F.lit(1).alias("seed"))
        if belief is not None:
            sure = sure.unionByName(edges.where("k < 0").join(belief, "v").select("pattern", "v", "kind", "n", "belief", F.lit(0).alias("seed")))
        good = sure.groupBy("pattern", "kind").agg(F.sum(F.col("n") * F.col("belief")).alias("good"), F.sum("seed").alias("seeds")).where(F.col("seeds") >= seeds)
        trusted = good.join(total, "pattern").select("pattern", "kind", (F.col("good") / (F.col("total") + PRIOR)).alias("p")).where(F.col("p") >= confidence)
        trusted = scratch.write(trusted, f"patterns{turn}")
        now = trusted.agg(F.count(F.lit(1)), F.sum(F.xxhash64("pattern", "kind", F.round("p", 3)).cast("decimal(38,0)"))).first()
        if not now[0]:
            return None
        if now == before:
            break
        reached = edges.where("k < 0").join(trusted, "pattern")
        belief = scratch.write(reached.groupBy("v", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.least("p", F.lit(0.999999)))))).alias("belief")), f"beliefs{turn}")
        before, turn = now, turn + 1
    best = belief.groupBy("v").agg(F.max(F.struct("belief", (-F.col("kind")).alias("kind"))).alias("b")).where(F.col("b.belief") >= confidence).select("v", (-F.col("b.kind")).alias("kind"))
    at = where.where("k < 0").join(trusted.select("pattern", "kind"), "pattern").join(scratch.write(best, "best"), ["v", "kind"]).select("__rid", "s", F.col("kind").alias("k"), "e")
    own = where.where(F.col("k") == KINDS.index("secret")).join(trusted.select("pattern", F.col("kind").alias("k")), ["pattern", "k"]).select("__rid", "s", "k", "e")
    return at.unionByName(own).distinct()


def find(docs: DataFrame, text_col: str = "text", keep: dict[str, str] | None = None) -> DataFrame:
    """The columns that keep names in a struct `kept`, base and spans: arrays of (s, k, e) in order of start, then kind; k is the place in KINDS."""
    scratch = Scratch(docs.sparkSession)
    rows = prepared(docs, scratch, text_col, keep)
    base = F.transform(_tagged(), lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))
    more = discovered(rows, scratch)
    if more is None:
        return rows.select(F.col("__kept").alias("kept"), base.alias("base")).withColumn("spans", F.col("base"))
    more = scratch.write(more.groupBy("__rid").agg(F.collect_list(F.struct("s", "k", "e")).alias("__more")), "discovered")
    out = rows.join(more, "__rid", "left").select(F.col("__kept").alias("kept"), base.alias("base"), "__more")
    return out.select("kept", "base", F.when(F.col("__more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "__more"))).alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span (merged where they overlap) replaced by its kind in brackets."""
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    # what stands before each span, from the end of those before it (a to b), and its label unless it is part of these
    gap = lambda at, x: (F.greatest(at, x["e"]), F.struct(at.alias("a"), F.greatest(at, x["s"]).alias("b"), F.when(x["s"] >= at, x["k"]).otherwise(-1).alias("k")))

    def block(part: Column) -> Column:  # one substring of the text, then short ones of that
        first = F.element_at(part, 1)["a"]
        inner = lambda own: F.array_join(F.transform(part, lambda g: F.concat(F.substring(own, g["a"] - first + 1, g["b"] - g["a"]), F.when(g["k"] >= 0, F.element_at(names, g["k"] + 1)).otherwise(""))), "")
        return _let(F.substring(text, first + 1, F.element_at(part, -1)["b"] - first), inner)

    gaps = _running(spans, F.lit(0), gap, "struct<a:int,b:int,k:int>")
    tail = F.substring(text, F.array_max(F.transform(spans, lambda x: x["e"])) + 1, F.char_length(text))
    return F.when(F.size(spans) > 0, F.concat(F.array_join(_let(gaps, lambda g: F.transform(_pieces(g), block)), ""), tail)).otherwise(text)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_spans counts all spans, found ones included."""
    found = find(table(spark, sf_dir, "documents"))
    count = lambda i: F.size(F.filter("base", lambda x: x["k"] == i)).cast("long")
    return found.select("kept.doc_id", *(count(i).alias(f"n_{k}") for i, k in enumerate(BASE)), F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
