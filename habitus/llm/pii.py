"""Personal data by bootstrapped contextual extraction, with DataFrame functions only.

Four kinds are found by their form. They are the seeds: the word before a seed is a pattern, and a pattern with its
identifiers forms a bipartite graph with the other tokens that look like identifiers and follow the same word. Scores go
back and forth: a pattern is as trustworthy for a kind as the identifiers it holds are, an identifier as the patterns that
hold it. Patterns and identifiers above THRESHOLD add their tokens to the spans of the kind.

Expressions for one form never back up over a run of characters twice, and repeated groups are rewritten as one class, so
texts of any length and any content take linear time and constant stack. A placeholder takes the place of single characters
for that, which keeps all positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from habitus.llm.text import stored

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
THRESHOLD = 0.6
SUPPORT = 3.0  # trusted identifiers that a pattern needs
REACH = 60  # characters before a token in which its pattern word is sought
MARK, OTHER = "", ""

LABEL = "A-Za-z0-9-"
LOCAL = f"A-Za-z0-9._%+{MARK}-"
#: kind: what the text must hold at all; the character made a placeholder, if any; the form.
FORMS = {
    "email": ("@", rf"\.(?![{LABEL}])", rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[{LABEL}]++\.[{LABEL}.]+"),
    "ip": (r"[0-9]\.[0-9]", None, r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": (r"[0-9]", r"(?<=[0-9])[ -](?=[0-9])", rf"[0-9][0-9{MARK}]+"),
    "phone": (r"\+[0-9]", None, r"\+[0-9][ ().0-9-]+[0-9]"),
}
EDGES = "[\\\"'(),.:;!?<>\\[\\]]"
ADDRESS = r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]"  # begins a token of its own
# Between groups of digits stands a dot, a hyphen, a bracket or blanks; what follows blanks must be digits and separators alone.
GROUP = rf"(?:\)?+(?:[.-]\(?+|(?: ?+-)?+ {{1,2}}+(?=\+?+\(?+[0-9][0-9().-]*+{EDGES}*+(?!\S))\(?+|\(?+)(?!{ADDRESS})[0-9]++)"
#: A token that may be an identifier: groups of digits with separators between them, or a run without white space.
TOKEN = rf"(?<!\S)(?:(?:{EDGES}|\+)*+[0-9]++{GROUP}++\S*+|[^\s0-9@]*+[0-9@]\S*+)"
TRIM = f"^{EDGES}+|(?<!{EDGES}){EDGES}++$"
SHORTEST = 6  # characters of an identifier that only its context gives away


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether at most 19 digits pass the Luhn check."""
    each = F.transform(F.sequence(F.lit(1), F.length(number)), lambda i: doubled(F.substring(F.reverse(number), i, F.lit(1)).cast("int"), i))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def doubled(digit: Column, place: Column) -> Column:
    twice = digit * 2
    return F.when(place % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(digit)


def holds(kind: str, match: Column) -> Column:
    """Whether a match of the form is of the kind."""
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
        return match.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    if kind == "card":
        number = digits(match)
        return F.when(F.length(number).between(13, 19), luhn(number)).otherwise(False)
    if kind == "phone":
        return F.length(digits(match)).between(9, 15)
    return F.lit(True)


def matches(text: Column, form: str, fields) -> Column:
    """All matches of a form in order, and the lengths that place them: gap (of the text since the last match) and length.

    fields(match, piece of text before it) gives skip and size (where in the match its span lies), holds, pattern and value.
    """
    turns = F.arrays_zip(F.split(text, form, -1).alias("p"), F.regexp_extract_all(text, F.lit(form), F.lit(0)).alias("m"))
    return F.transform(F.filter(turns, lambda x: x["m"].isNotNull()), lambda x, i: F.struct(
        i.alias("place"), F.length(x["p"]).alias("gap"), F.length(x["m"]).alias("length"), *fields(x["m"], x["p"])))


def before(piece: Column) -> Column:
    """The last word of the text before a token, lower case, without punctuation at its edges; empty if there is none."""
    word = F.substring_index(F.rtrim(F.regexp_replace(F.right(piece, F.lit(REACH)), r"\s+", " ")), " ", -1)
    return F.lower(F.regexp_replace(word, TRIM, ""))


HIT = "array<struct<place:int,gap:int,length:int,skip:int,size:int,holds:boolean,pattern:string,value:string>>"


def hit(kept: Column, skip: Column, size: Column, pattern: Column, value: Column) -> list[Column]:
    """The fields of a match; one that is not kept only counts for the places of those after it."""
    return [skip.cast("int").alias("skip"), size.cast("int").alias("size"), kept.alias("holds"), F.when(kept, pattern).alias("pattern"), F.when(kept, value).alias("value")]


def base_hits(column: str = "text") -> dict[str, Column]:
    """Per kind all matches of its form; a null text has none."""
    clean = F.translate(F.coalesce(F.col(column), F.lit("")), MARK, OTHER)
    out = {}
    for kind, (must, marked, form) in FORMS.items():
        text = F.regexp_replace(clean, marked, MARK) if marked else clean
        fields = lambda m, p, kind=kind: hit(holds(kind, m), F.lit(0), F.length(m), before(p), F.lower(digits(m) if kind in ("card", "phone") else m))
        out[kind] = F.when(clean.rlike(must), matches(text, form, fields).cast(HIT)).otherwise(F.array().cast(HIT))
    return out


def token_hits(column: str = "text") -> Column:
    """All tokens that may be identifiers, without punctuation at their edges."""
    clean = F.coalesce(F.col(column), F.lit(""))

    def fields(m: Column, p: Column) -> list[Column]:
        left = F.length(m) - F.length(F.regexp_replace(m, f"^{EDGES}+", ""))
        core = F.regexp_replace(m, TRIM, "")
        opened = core.rlike(r"^\+?[0-9]++\)") & (F.substring(m, left, F.lit(1)) == "(")  # a bracket around the first group is its own
        left, core = left - F.when(opened, 1).otherwise(0), F.when(opened, F.concat(F.lit("("), core)).otherwise(core)
        return hit((F.length(core) >= SHORTEST) & (before(p) != ""), left, F.length(core), before(p), F.lower(core))

    return F.when(clean.rlike("[0-9@]"), matches(clean, TOKEN, fields).cast(HIT)).otherwise(F.array().cast(HIT))


def placed(rows: DataFrame) -> DataFrame:
    """row, kind (its place in KINDS, one more for tokens), start, end, pattern and value of the spans in column hits.

    Positions are running sums of lengths. Tokens that a base span overlaps are left out: in order of start, the ends behind
    and the starts ahead decide that. So time grows with a text even if it is all matches.
    """
    each = rows.select("row", F.posexplode("hits").alias("kind", "of")).select("row", "kind", F.explode("of").alias("h")).select("row", "kind", "h.*")
    end = F.sum((F.col("gap") + F.col("length")).cast("long")).over(Window.partitionBy("row", "kind").orderBy("place"))
    start = (F.col("_end") - F.col("length") + F.col("skip")).cast("int")
    spans = each.withColumn("_end", end).filter("holds").select("row", "kind", start.alias("start"), (start + F.col("size")).alias("end"), "pattern", "value")
    forth, back = Window.partitionBy("row").orderBy("start", "kind"), Window.partitionBy("row").orderBy(F.desc("start"), F.desc("kind"))
    before_it = (Window.unboundedPreceding, -1)
    base = F.col("kind") < len(KINDS)
    reached = F.max(F.when(base, F.col("end"))).over(forth.rowsBetween(*before_it))
    ahead = F.min(F.when(base, F.col("start"))).over(back.rowsBetween(*before_it))
    free = F.coalesce(F.col("reached") <= F.col("start"), F.lit(True)) & F.coalesce(F.col("ahead") >= F.col("end"), F.lit(True))
    return spans.withColumns({"reached": reached, "ahead": ahead}).filter(base | free).drop("reached", "ahead")


def trusted_patterns(edges: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(pattern, kind, score) and (value, kind, score) above THRESHOLD, from edges (pattern, value, kind); kind is null for
    tokens of no known kind.

    A pattern's score for a kind is the sum of its values' scores over one more than the number of its values. A value is
    wrong only if all its patterns are. Sums are pre-aggregated, and the joins with patterns have one row a pattern and kind.
    """
    edges = stored(edges.groupBy("pattern", "value", "kind").agg(F.lit(1).alias("one")).drop("one"), "edges")
    seeds = edges.filter("kind IS NOT NULL").select("value", "kind", F.lit(1.0).alias("score")).distinct()
    pairs = stored(edges.select("pattern", "value").distinct(), "edges")
    sizes = pairs.groupBy("pattern").agg(F.count("*").alias("values"))
    values, patterns = seeds, None
    for _ in range(rounds):
        patterns = stored(
            pairs.join(values, "value").groupBy("pattern", "kind").agg(F.sum("score").alias("sum")).filter(F.col("sum") >= SUPPORT)
            .join(sizes, "pattern").select("pattern", "kind", (F.col("sum") / (F.col("values") + 1)).alias("score")).filter(F.col("score") >= THRESHOLD), "patterns")
        learned = pairs.join(patterns, "pattern").groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.least("score", F.lit(0.999999)))))).alias("score"))
        values = stored(seeds.union(learned.join(seeds.select("value").distinct(), "value", "left_anti")), "values")
    return patterns, values.filter(F.col("score") >= THRESHOLD)


def find(documents: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Per row: doc_id, base (spans by form) and added (spans by trusted patterns), each an array of kind, start, end.

    Positions are code points, ends exclusive. Null and empty texts have no spans; rows with equal or null ids are searched
    each on its own.
    """
    hits = F.array(*base_hits().values(), token_hits())
    rows = stored(documents.select("doc_id", hits.alias("hits")).withColumn("row", F.monotonically_increasing_id()), "hits")
    spans = stored(placed(rows), "spans")
    named = F.get(F.array(*map(F.lit, KINDS)), F.col("kind"))
    base = spans.filter(F.col("kind") < len(KINDS)).withColumn("kind", named)
    unknown = spans.filter(F.col("kind") == len(KINDS)).drop("kind")
    known = base.filter("pattern <> ''").select("pattern", "value", "kind")
    patterns, values = trusted_patterns(known.union(unknown.select("pattern", "value", F.lit(None).cast("string"))), rounds)
    added = (
        unknown.join(patterns.select("pattern", "kind"), "pattern").join(values.select("value", "kind", "score"), ["value", "kind"])
        .groupBy("row", "start", "end").agg(F.max(F.struct("score", "kind")).kind.alias("kind")).select("row", F.lit(True).alias("by_context"), "kind", "start", "end")
    )
    both = base.select("row", F.lit(False).alias("by_context"), "kind", "start", "end").union(added)
    listed = lambda which: F.array_sort(F.collect_list(F.when(which, F.struct("kind", "start", "end"))))
    per_row = both.groupBy("row").agg(listed(~F.col("by_context")).alias("base"), listed(F.col("by_context")).alias("added"))
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    joined = rows.select("row", "doc_id").join(per_row, "row", "left")
    return joined.select("doc_id", by_kind(F.coalesce("base", none)).alias("base"), F.coalesce("added", none).alias("added"))


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def by_kind(spans: Column) -> Column:
    """Spans by kind as listed, then by start."""
    return F.concat(*(F.array_sort(of_kind(spans, k)) for k in KINDS))


def report(found: DataFrame) -> DataFrame:
    """Counts of the spans by form, their hash, and all spans as text."""
    counts = [F.size(of_kind(F.col("base"), k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"), written(by_kind(F.concat("base", "added"))).alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; overlapping spans are replaced together."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def step(a: Column, s: Column) -> Column:
        gap = F.substring(text, a["at"] + 1, s["start"] - a["at"])
        parts = F.when(s["start"] >= a["at"], F.concat(a["out"], F.array(gap, F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))))).otherwise(a["out"])
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), parts.alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.slice(F.array(F.lit("")), 1, 0).alias("out"))
    done = F.aggregate(order, start, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)
