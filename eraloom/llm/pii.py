"""Personal data by candidate generation and boosted trees, in DataFrame expressions only.

Base patterns give spans of four kinds that always stay. Looser generators
propose further spans, which may overlap: e-mail addresses written out with
"at" and "dot", card numbers and phone numbers inside longer runs of digits
that fail as a whole, phone numbers without a plus sign, dotted quads inside
longer chains. Boosted trees score each candidate by its format and context,
and a threshold for each kind, calibrated on documents that the trees have not
seen, selects those to add.

Everything happens inside a row: the trees are written as one SQL expression
and applied to an array of candidates, so texts are never shuffled and no
Python runs on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from eraloom.session import materialize

# Rows, each of one label and features, that a task grows the trees on.
TRAIN_ROWS = 200_000
# Share of right spans, on documents not learned from, that a kind's threshold must reach.
PRECISION = 0.95
CONTEXT = 24

# The kinds in their order, and the base patterns. Possessive
# quantifiers and looks behind keep the search linear and match the same spans
# as email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+,
# ip [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+), card [0-9]([\x20-]?[0-9])+ (only runs
# of at least 13 digits can pass), phone \+[0-9][\x20().0-9-]+[0-9].
KINDS = ("email", "ip", "card", "phone")
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Cheap tests that spare most texts the search.
HINT = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
# Looser generators.
LOOSE = {
    "email": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:@|[(\[]at[)\]]|\x20at\x20)\x20?[A-Za-z0-9-]{1,63}+(?:(?:\.|\x20?[(\[]dot[)\]]\x20?|\x20dot\x20)[A-Za-z0-9-]{1,63}+){1,8}+",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[\x20-][0-9]{4}){3})(?![0-9])",
    "phone": r"(?:\+[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{2,4}\)\x20?|(?<![0-9])[0-9]{3}[\x20.-])[0-9]{3,4}[\x20.-][0-9]{4}(?![0-9])",
}
LOOSE_HINT = {"email": r"(?i)[@]|[(\[\x20]at[)\]\x20]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9]{4}[\x20-]?[0-9]{4}", "phone": r"[0-9][\x20.-][0-9]{4}"}
# Words before a span that speak for each kind.
CUES = {"email": "mail|contact|write|kontakt|correo|courriel", "ip": "ip|host|server|address|adresse", "card": "card|visa|karte|carte|tarjeta|pay", "phone": "phone|tel|call|fax|mobil"}
FEATURES = (
    "kind", "length", "digits", "letters", "separators", "groups", "luhn", "quad", "plus", "brackets", "at_sign", "cue",
    "written", "before_digit", "before_letter", "after_digit", "after_letter", "distinct_digits", "cut_left", "cut_right",
)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return (n > 0) & (F.aggregate(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), F.lit(0), add) % 10 == 0)


def quad(s: Column) -> Column:
    """Whether all parts of a dotted quad are at most 255."""
    return s.rlike(r"\A(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|\z)){4}\z")


def _passes(kind: str, s: Column) -> Column:
    n = F.length(_digits(s))
    if kind == "ip":
        return quad(s)
    if kind == "card":
        return n.between(13, 19) & luhn(_digits(s))
    return n.between(9, 15) if kind == "phone" else F.lit(True)


BLOCK = 64


def matches(text: Column, pattern: str, hint: str) -> Column:
    """All matches of a pattern as array of (gap, match): the code points since the last match, and the text.

    Starts are running sums over gaps and matches (``placed``); sums of whole
    blocks come first, so many matches in one text do not cost their square.
    """
    p = F.lit(pattern)
    found = F.regexp_extract_all(text, p, F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    pairs = F.when(text.rlike(hint), F.arrays_zip(gaps.alias("gap"), found.alias("match"))).otherwise(F.array().cast("array<struct<gap:int,match:string>>"))
    # The last gap has no match.
    return F.filter(pairs, lambda x: x["match"].isNotNull())


def _width(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0), lambda s, x: s + x["gap"] + F.length(x["match"]))


def with_matches(df: DataFrame, patterns: dict[str, str], hints: dict[str, str]) -> DataFrame:
    """``df`` with, for each kind k, ``_k``: the matches in ``_text``, and ``_k_sums``: the widths of their blocks.

    Each step is a column of its own, so that no lambda evaluates another step anew for every element.
    """
    for k in KINDS:
        df = df.withColumn(f"_{k}", matches(F.col("_text"), patterns[k], hints[k]))
    for k in KINDS:
        blocks = F.sequence(F.lit(0), F.greatest((F.size(f"_{k}") - 1) / BLOCK, F.lit(0)).cast("int"))
        df = df.withColumn(f"_{k}_sums", _block_sums(k, blocks))
    return df


def _block_sums(k: str, blocks: Column) -> Column:
    return F.transform(blocks, lambda b: _width(F.slice(F.col(f"_{k}"), b * BLOCK + 1, F.lit(BLOCK))))


def placed(k: str) -> Column:
    """(start, match) from the (gap, match) pairs of kind ``k``."""

    def place(x: Column, i: Column) -> Column:
        b = (i / BLOCK).cast("int")
        before = F.aggregate(F.slice(F.col(f"_{k}_sums"), F.lit(1), b), F.lit(0), lambda s, y: s + y)
        return F.struct((before + _width(F.slice(F.col(f"_{k}"), b * BLOCK + 1, i % BLOCK)) + x["gap"]).cast("long").alias("start"), x["match"].alias("match"))

    return F.transform(F.col(f"_{k}"), place)


def _of_kind(i: int, strict: bool) -> Column:
    """Array of (kind number, start, end, match) from the matches of kind ``i``; ``strict`` drops those that fail its check."""
    found = placed(KINDS[i])
    if strict:
        found = F.filter(found, lambda x: _passes(KINDS[i], x["match"]))
    return F.transform(found, lambda x: F.struct(F.lit(i).alias("kind"), x["start"].alias("start"), (x["start"] + F.length(x["match"])).alias("end"), x["match"].alias("match")))


def base_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_base``: array of (kind number, start, end, match), ordered by kind and start; null text counts as empty."""
    df = with_matches(docs.withColumn("_text", F.coalesce("text", F.lit(""))), BASE, HINT)
    return df.withColumn("_base", F.concat(*[_of_kind(i, True) for i in range(len(KINDS))])).drop(*[f"_{k}{x}" for k in KINDS for x in ("", "_sums")])


def candidates(df: DataFrame) -> DataFrame:
    """Base spans' frame with ``_found``: loose candidates as (kind, start, end, match, base, cut, features).

    ``base`` says that the span is a base span of its kind, ``cut`` that it
    overlaps one without being it.
    """
    df = with_matches(df, LOOSE, LOOSE_HINT)
    df = df.withColumn("_loose", F.concat(*[_of_kind(i, False) for i in range(len(KINDS))])).drop(*[f"_{k}{x}" for k in KINDS for x in ("", "_sums")])

    def full(c: Column) -> Column:
        own = lambda b: (b["start"] == c["start"]) & (b["end"] == c["end"]) & (b["kind"] == c["kind"])
        meets = lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])
        base = F.exists("_base", own)
        start = c["start"].cast("int")
        left = F.substring(F.col("_text"), F.greatest(start - CONTEXT + 1, F.lit(1)), F.least(start, F.lit(CONTEXT)))
        right = F.substring(F.col("_text"), c["end"].cast("int") + 1, F.lit(2))
        m, d = c["match"], _digits(c["match"])
        num = lambda x: x.cast("double")
        cue = F.lit(False)
        for i, k in enumerate(KINDS):
            cue = cue | ((c["kind"] == i) & left.rlike(f"(?i)\\b(?:{CUES[k]})"))
        values = {
            "kind": c["kind"], "length": F.length(m), "digits": F.length(d), "letters": F.length(F.regexp_replace(m, "[^A-Za-z]", "")),
            "separators": F.length(F.regexp_replace(m, r"[^\x20.()-]", "")), "groups": F.size(F.split(m, r"[^0-9]+")),
            "luhn": luhn(d), "quad": quad(m), "plus": m.startswith("+"), "brackets": m.contains("("), "at_sign": m.contains("@"), "cue": cue,
            "written": m.rlike(r"(?i)[(\[](?:at|dot)[)\]]|\x20dot\x20"),
            "before_digit": left.rlike(r"[0-9][\x20.+-]?\z"), "before_letter": left.rlike(r"[A-Za-z]\z"),
            "after_digit": right.rlike(r"\A[\x20.-]?[0-9]"), "after_letter": right.rlike(r"\A[A-Za-z]"),
            "distinct_digits": F.size(F.array_distinct(F.split(d, ""))),
            "cut_left": left.rlike(r"[0-9+(]\z"), "cut_right": right.rlike(r"\A[0-9]"),
        }
        return F.struct(
            c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), base.alias("base"), F.exists("_base", meets).alias("cut"),
            F.array(*[num(values[f]) for f in FEATURES]).alias("features"),
        )

    return df.withColumn("_found", F.transform("_loose", full)).drop("_loose")


# --- the trees as SQL --------------------------------------------------------


@dataclass(frozen=True)
class Model:
    """SQL for a candidate's margin, over ``c.features``, and the least margin for each kind (null: none passes)."""

    margin: str
    least: tuple[float | None, ...]


def _as_sql(node) -> str:
    if node.getClass().getSimpleName().startswith("Leaf"):
        return repr(float(node.prediction())) + "D"
    split = node.split()
    return f"CASE WHEN c.features[{split.featureIndex()}] <= {float(split.threshold())!r}D THEN {_as_sql(node.leftChild())} ELSE {_as_sql(node.rightChild())} END"


def trees_as_sql(model: GBTClassificationModel) -> str:
    """The model's margin; the score is 1 / (1 + exp(-2 margin))."""
    return " + ".join(f"{w!r}D * ({_as_sql(t._java_obj.rootNode())})" for t, w in zip(model.trees, model.treeWeights)) or "0D"


def fit(docs: DataFrame) -> Model | None:
    """Learn from all documents with an id; None if they show only one class.

    A candidate is right when it is a base span or passes its kind's check
    without cutting into a base span; that is what strict patterns can vouch
    for, while the trees see only format and context. Two thirds of the
    documents grow the trees, one third sets the thresholds. Candidates of one
    kind, label and features are one row with their number as its weight, so
    what the trees are grown on grows with the formats, not with the documents.
    """
    # Written before the arrays are exploded, so that each text is searched once.
    rows = materialize(candidates(base_spans(docs.select("doc_id", "text").where("doc_id is not null"))).select("doc_id", "_found")).select("doc_id", F.explode("_found").alias("c"))
    at = FEATURES.index
    f = lambda name: F.col("c.features")[at(name)]
    digits = f("digits")
    strict = (
        F.when(F.col("c.kind") == 0, f("written") == 1)
        .when(F.col("c.kind") == 1, f("quad") == 1)
        .when(F.col("c.kind") == 2, (f("luhn") == 1) & digits.between(13, 19))
        .otherwise(digits.between(9, 15) & ((f("plus") == 1) | (f("brackets") == 1)))
    )
    right = F.col("c.base") | (~F.col("c.cut") & strict & (f("cut_left") == 0) & (f("cut_right") == 0))
    part = F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(3))
    rows = rows.select(right.cast("int").alias("label"), F.col("c.kind").alias("kind"), F.col("c.features").alias("features"), (part < 2).alias("grows"))
    rows = materialize(rows.groupBy("label", "kind", "features", "grows").agg(F.count("*").alias("n")))
    train = rows.where("grows")
    if train.select("label").distinct().count() < 2:
        return None
    parts = -(-train.count() // TRAIN_ROWS)
    # In one order, so that sums of fractions are the same each time.
    train = train.repartition(parts, "features").sortWithinPartitions("features", "label").select("label", F.col("n").cast("double").alias("weight"), array_to_vector("features").alias("features"))
    trees = GBTClassifier(maxIter=12, maxDepth=4, stepSize=0.3, seed=2, weightCol="weight").fit(train)
    margin = trees_as_sql(trees)
    # Thresholds: per kind, the least margin above which the share of right candidates is high enough.
    held = rows.where("not grows").select("kind", "label", "n", F.expr(margin.replace("c.features", "features")).alias("margin"))
    steps = held.groupBy("kind", F.round("margin", 3).alias("margin")).agg(F.sum("n").alias("n"), F.sum(F.col("label") * F.col("n")).alias("good")).collect()  # margins are sums of a few leaves
    least: list[float | None] = []
    for k in range(len(KINDS)):
        n = good = 0
        found = None
        for r in sorted((r for r in steps if r["kind"] == k), key=lambda r: -r["margin"]):
            n, good = n + r["n"], good + r["good"]
            if good >= PRECISION * n:
                found = r["margin"] - 0.0005
        least.append(found)
    return Model(margin, tuple(least))


def with_spans(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with ``_base`` and ``_spans`` (kind, start, end): the base spans and the candidates that pass.

    A candidate that meets a base span of any kind, or an earlier selected
    candidate of its own kind, is not added.
    """
    df = base_spans(docs)
    span = lambda b: F.struct(b["kind"].alias("kind"), b["start"].alias("start"), b["end"].alias("end"))
    if model is None:
        return df.withColumn("_spans", F.transform("_base", span))
    df = candidates(df)
    least = "CASE c.kind " + " ".join(f"WHEN {k} THEN {'double(\"infinity\")' if x is None else repr(x) + 'D'}" for k, x in enumerate(model.least)) + " END"
    df = df.withColumn("_added", F.expr(f"filter(_found, c -> NOT c.cut AND ({model.margin}) >= {least})"))
    # Loose spans of one kind never overlap each other; those of a later kind give way.
    free = lambda c: ~F.exists("_added", lambda a: (a["kind"] < c["kind"]) & (a["start"] < c["end"]) & (c["start"] < a["end"]))
    added = F.transform(F.filter("_added", free), span)
    return df.withColumn("_spans", F.array_sort(F.concat(F.transform("_base", span), added))).drop("_found", "_added")


def _joined(spans: str) -> Column:
    kind = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, counts of base spans by kind, ``base_sha256`` and ``spans``.

    Every row is kept, repeated ones too; null texts are empty, null ids stay
    null and are not learned from. Offsets are code points, ends exclusive.
    Other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    df = with_spans(docs, fit(docs))
    count = lambda i: F.size(F.filter("_base", lambda b: b["kind"] == i)).cast("long").alias(f"n_{KINDS[i]}")
    return df.select("doc_id", *[count(i) for i in range(len(KINDS))], F.sha2(_joined("_base").cast("binary"), 256).alias("base_sha256"), _joined("_spans").alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each span in ``text`` replaced by its kind in angle brackets; overlapping spans become the first one's.

    All columns are kept; ``n_chars``, where there is one, is the new length.
    Texts without spans, also null ones, stay as they are.
    """
    own = docs.columns
    df = with_spans(docs, fit(docs))
    ordered = F.array_sort(F.transform("_spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    df = df.withColumn("_order", ordered)
    # Spans that begin inside an earlier one add nothing but their end.
    before = lambda i: F.coalesce(F.array_max(F.transform(F.slice("_order", F.lit(1), i), lambda s: s["end"])), F.lit(0))
    kind = F.array(*map(F.lit, KINDS))

    def part(s: Column, i: Column) -> Column:
        done = before(i)
        gap = F.substring(F.col("_text"), (done + 1).cast("int"), F.greatest(s["start"] - done, F.lit(0)).cast("int"))
        return F.when(s["start"] < done, F.lit("")).otherwise(F.concat(gap, F.lit("<"), F.upper(kind[s["kind"]]), F.lit(">")))

    rest = F.expr("substring(_text, int(coalesce(array_max(transform(_order, s -> s.end)), 0L) + 1))")
    text = F.when(F.size("_order") > 0, F.concat(F.array_join(F.transform("_order", part), ""), rest)).otherwise(F.col("text"))
    size = [F.length(text).cast(dict(docs.dtypes)["n_chars"]).alias("n_chars")] if "n_chars" in own else []
    return df.select(*[text.alias("text") if c == "text" else size[0] if c == "n_chars" else F.col(c) for c in own])
