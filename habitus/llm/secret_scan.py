"""Secrets by form, and by two character Markov models, with DataFrame functions only.

Three kinds are found by their form. What these forms hold, and strings that are random by construction, are the samples
labelled random; runs of identifier characters that look like words, alone or joined by separators, are the samples labelled
ordinary. Each label gets a first-order Markov model of characters. Another run of identifier characters is a secret of kind
`random` if its log-likelihood ratio of the two models is high enough for its length.

A text's matches leave it as lengths: of each match, and of the gap before it. Positions are running sums over these rows,
and overlaps are found by one sorted pass over the spans of a text, so time grows with the text even if it is all matches.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from habitus.llm.text import collected, stored

KINDS = ("assign", "access", "hex", "random")
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
START = len(ALPHABET)  # stands before the first character
RUN = "[A-Za-z0-9+/_=-]"
KEYWORD = "(?i:password|passwd|secret|token|api_?key)"
#: kind: a quick test that every text with a match passes; the form. ASSIGNED is the form with its value as group 1.
ASSIGNED = rf"{KEYWORD}[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
FORMS = {
    "assign": (rf"{KEYWORD}[\"']?\x20*[:=]", ASSIGNED),
    "access": ("AKIA[A-Z0-9]{14}", "AKIA[A-Z0-9]{14,}"),
    "hex": ("[0-9a-f]{16}", "[0-9a-f]{16,}"),
}
VALUE = 12  # characters of an assigned value
LONG = 20  # characters of a run that the models judge
ORDINARY = 10  # characters of a run that is a sample of ordinary ones
WORDS = "^(?:[A-Za-z]++|[0-9]++)(?:[_/+=-]++(?:[A-Za-z]++|[0-9]++))*+[_/+=-]*+$"
GENERATED = 2000  # random samples of each of three alphabets
SMOOTH, PRIOR = 0.5, 5.0  # counts added to each character, and counts that a character's share stands for
LEAST = 3.0  # nats a character by which the random model must be the better one
MICRO = 1_000_000  # ratios are whole numbers of this part of a nat, so that sums do not depend on their order


def may_hold(kind: str, text: Column) -> Column:
    test = text.rlike(FORMS[kind][0])
    return (F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))) & test if kind == "assign" else test


def matches(text: Column, form: str) -> Column:
    """gap (length of the text since the last match), value of each match; at the end a gap alone, with a null value."""
    turns = F.arrays_zip(F.split(text, form, -1).alias("p"), F.regexp_extract_all(text, F.lit(form), F.lit(0)).alias("m"))
    return F.transform(turns, lambda x: F.struct(F.length(x["p"]).alias("gap"), x["m"].alias("value")))


def characters(value: Column) -> Column:
    return F.filter(F.split(value, ""), lambda c: c != "")


def code(character: Column) -> Column:
    return F.instr(F.lit(ALPHABET), character) - 1


def generated(spark, each: int = GENERATED) -> DataFrame:
    """Strings that are random by construction: digests in hexadecimal, in base 64 and in capitals and digits."""
    digest = F.sha2(F.col("id").cast("string").cast("binary"), 256)
    base64 = F.base64(F.unhex(digest))
    forms = F.array(F.substring(digest, 1, 40), F.regexp_replace(base64, "=", ""), F.upper(F.regexp_replace(base64, "[^A-Za-z0-9]", "")))
    return spark.range(each).select(F.explode(forms).alias("value"), F.lit("random").alias("label"))


def samples(documents: DataFrame, each: int = GENERATED) -> DataFrame:
    """(value, label) of distinct labelled samples from whole texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    values, rest = [], text
    for kind, (_, form) in FORMS.items():
        found = F.regexp_extract_all(text, F.lit(form), F.lit(1 if kind == "assign" else 0))
        values.append(F.when(may_hold(kind, text), F.filter(found, lambda v: F.length(v) >= VALUE)).otherwise(F.array().cast("array<string>")))
        rest = F.when(may_hold(kind, text), F.regexp_replace(rest, form, " ")).otherwise(rest)
    runs = F.filter(F.regexp_extract_all(rest, F.lit(f"{RUN}{{{ORDINARY},}}"), F.lit(0)), lambda v: v.rlike(WORDS))
    labelled = lambda each, label: F.transform(each, lambda v: F.struct(v.alias("value"), F.lit(label).alias("label")))
    rows = documents.select(F.explode(F.concat(labelled(F.concat(*values), "random"), labelled(runs, "ordinary"))).alias("s")).select("s.value", "s.label")
    return rows.union(generated(documents.sparkSession, each)).groupBy("value", "label").agg(F.lit(1).alias("one")).drop("one")


def transitions(labelled: DataFrame) -> DataFrame:
    """label, before, after, n: how often one character follows another; START stands before the first. Every distinct
    value counts once; characters outside ALPHABET are left out."""
    codes = F.filter(F.transform(characters(F.col("value")), code), lambda c: c >= 0)
    rows = labelled.select("label", codes.alias("c")).filter(F.size("c") > 0)
    steps = F.arrays_zip(F.concat(F.array(F.lit(START)), F.slice("c", F.lit(1), F.size("c") - 1)).alias("before"), F.col("c").alias("after"))
    return rows.select("label", F.explode(steps).alias("s")).groupBy("label", "s.before", "s.after").agg(F.count("*").alias("n"))


def ratios(counted: DataFrame, smooth: float = SMOOTH, prior: float = PRIOR) -> list[int]:
    """Log ratio of the random to the ordinary model of each (before, after), before changing slowest, in whole MICROs.

    A transition is estimated from its own count and, with the weight of PRIOR counts, from the share of its character in all
    values of the label, so what a label never showed is unlikely after any character. counted has at most two rows a pair
    of characters, so it may come to the driver. A label without samples is uniform.
    """
    table = {(r.label, r.before, r.after): r.n for r in collected(counted).itertuples()}
    size = len(ALPHABET)
    model = {}
    for label in ("random", "ordinary"):
        share = [sum(table.get((label, before, after), 0) for before in range(START + 1)) + smooth for after in range(size)]
        share = [n / sum(share) for n in share]
        for before in range(START + 1):
            counts = [table.get((label, before, after), 0) for after in range(size)]
            model[label, before] = [(n + prior * s) / (sum(counts) + prior) for n, s in zip(counts, share)]
    return [round(MICRO * (math.log(a) - math.log(b))) for before in range(START + 1) for a, b in zip(model["random", before], model["ordinary", before])]


def fit(documents: DataFrame) -> list[int]:
    """The model of all documents."""
    return ratios(transitions(samples(documents)))


def likelihood_ratio(value: Column, model: list[int]) -> Column:
    """Sum of the log ratios along a value, in MICROs; all of its characters are in ALPHABET."""
    table = F.split(F.lit(",".join(map(str, model))), ",").cast("array<bigint>")  # folded once into a constant

    def step(a: Column, c: Column) -> Column:
        return F.struct(code(c).alias("last"), (a["sum"] + F.element_at(table, a["last"] * len(ALPHABET) + code(c) + 1)).alias("sum"))

    return F.aggregate(characters(value), F.struct(F.lit(START).alias("last"), F.lit(0).cast("bigint").alias("sum")), step, lambda a: a["sum"])


def looks_random(value: Column, model: list[int], least: float = LEAST) -> Column:
    return likelihood_ratio(value, model) >= F.length(value).cast("long") * round(least * MICRO)


def hits(text: Column, model: list[int], least: float = LEAST) -> Column:
    """kind (place in KINDS), place, gap, length, holds (whether the match is one of the kind) of all matches of all kinds."""
    clean = F.coalesce(text, F.lit(""))
    none = F.array().cast("array<struct<kind:int,place:int,gap:int,length:int,holds:boolean>>")

    def of(kind: str, test: Column, form: str, holds) -> Column:
        row = lambda x, i: F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), i.alias("place"), x["gap"].alias("gap"), F.length(x["value"]).alias("length"), holds(x["value"]).alias("holds"))
        return F.when(test, F.transform(F.filter(matches(clean, form), lambda x: x["value"].isNotNull()), row)).otherwise(none)

    long_enough = lambda v: F.length(F.regexp_extract(v, ASSIGNED, 1)) >= VALUE
    forms = [of(k, may_hold(k, clean), form, long_enough if k == "assign" else lambda v: F.lit(True)) for k, (_, form) in FORMS.items()]
    return F.concat(*forms, of("random", clean.rlike(f"{RUN}{{{LONG}}}"), f"{RUN}{{{LONG},}}", lambda v: looks_random(v, model, least)))


def find(documents: DataFrame, model: list[int], least: float = LEAST) -> DataFrame:
    """Per row: doc_id, base (spans by form) and added (runs that look random and overlap no base span), each an array of kind,
    start, end in order of start, then of kind as listed.

    Positions are code points, ends exclusive. Null and empty texts have no spans; rows with equal or null ids are searched
    each on its own. Other columns are not read.
    """
    rows = stored(documents.select("doc_id", hits(F.col("text"), model, least).alias("hits")).withColumn("row", F.monotonically_increasing_id()), "hits")
    each = rows.select("row", F.explode("hits").alias("h")).select("row", "h.*")
    end = F.sum(F.col("gap") + F.col("length")).over(Window.partitionBy("row", "kind").orderBy("place"))
    spans = each.withColumn("end", end.cast("int")).filter("holds").select("row", "kind", (F.col("end") - F.col("length")).alias("start"), "end")
    forth, back = Window.partitionBy("row").orderBy("start", "kind"), Window.partitionBy("row").orderBy(F.desc("start"), F.desc("kind"))
    before = (Window.unboundedPreceding, -1)  # a frame that ends at the last row would be gone through anew for each row
    base = F.col("kind") < KINDS.index("random")
    reached = F.max(F.when(base, F.col("end"))).over(forth.rowsBetween(*before))
    ahead = F.min(F.when(base, F.col("start"))).over(back.rowsBetween(*before))
    apart = spans.withColumns({"reached": reached, "ahead": ahead}).filter(
        base | (F.coalesce(F.col("reached") <= F.col("start"), F.lit(True)) & F.coalesce(F.col("ahead") >= F.col("end"), F.lit(True))))
    per_row = apart.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))
    names = F.array(*map(F.lit, KINDS))
    named = lambda keep: F.transform(F.filter(F.coalesce("spans", F.array().cast("array<struct<start:int,kind:int,end:int>>")), keep), lambda s: F.struct(
        F.get(names, s["kind"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    added = KINDS.index("random")
    return rows.select("row", "doc_id").join(per_row, "row", "left").select("doc_id", named(lambda s: s["kind"] < added).alias("base"), named(lambda s: s["kind"] == added).alias("added"))


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(found: DataFrame) -> DataFrame:
    """Counts of the spans by form, their hash, and all spans as text, by start, then by kind as listed."""
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [number(k) for k in KINDS[:-1]]
    place = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"])
    both = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"].alias("start"), place(s).alias("place"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return found.select("doc_id", *counts, F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"), written(both).alias("spans"))
