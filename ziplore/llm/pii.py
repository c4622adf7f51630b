"""Personal data: generators propose spans, boosted trees accept or reject them.

Four base kinds are fixed patterns with a check and always stay. Further
generators propose freely: spelled-out addresses, local phone numbers, national
ids, bank accounts and long numbers, overlapping each other as they like. What
no base span covers is scored by gradient-boosted trees over format and context
features; a kind's spans are taken above a threshold calibrated for precision
on labelled texts that the trees have not seen.

The trees are trained on texts made from a list of formats and contexts (a
corpus carries no span labels) and turned into one SQL expression, so texts are
searched, scored and redacted in a single pass without a shuffle or Python.

Defined results: a null text counts as empty; repeated rows are searched each;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ziplore.llm.spans import ranked, spans_where, spans_with_context
from ziplore.session import pin

LOCAL = r"A-Za-z0-9._%+-"
#: Base patterns. Possessive, and started only where a run begins or the last
#: match ended: the same matches without backtracking over long runs.
EMAIL = rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){11,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

#: Proposed kinds, in the order in which they are listed after the base kinds.
PROPOSED = {
    "email_text": r"(?i)(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{2,40}\x20?[\[({]?\x20?(?:at|@)\x20?[\])}]?\x20?"
    r"[A-Za-z0-9-]{2,40}\x20?[\[({]?\x20?(?:dot|\.)\x20?[\])}]?\x20?[A-Za-z]{2,10}(?![A-Za-z])",
    "phone_local": r"(?<![0-9+.-])\(?[0-9]{3,4}\)?[\x20./-][0-9]{3,4}[\x20.-][0-9]{3,5}(?![0-9])",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "long_number": r"(?<![0-9.,-])[0-9](?:[\x20-]?[0-9]){8,20}(?![0-9.,-])",
}
GATES = {
    "email_text": r"(?i)[\x20\[({](?:at|@)[\x20\])}]",
    "phone_local": r"[0-9]{3}",
    "national_id": r"-[0-9]{2}-",
    "iban": r"[A-Z]{2}[0-9]{2}",
    "long_number": r"[0-9]{2}",
}
FEATURES = ("kind", "digits", "letters", "upper", "other", "brackets", "luhn", "mail", "phone", "identity", "bank", "plain", "glued")

#: Rows of the labelled texts, iterations and depth of the trees, and the share
#: of right spans wanted among those accepted.
TRAINING_ROWS = 6000
ITERATIONS = 10
DEPTH = 3
PRECISION = 0.97


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    total = F.aggregate(
        F.sequence(F.lit(1), F.char_length(digits)),
        F.lit(0),
        lambda acc, i: acc
        + F.when(
            (F.char_length(digits) - i) % 2 == 1,
            (F.substring(digits, i, F.lit(1)).cast("int") * 2) % 10
            + F.floor(F.substring(digits, i, F.lit(1)).cast("int") / 5).cast("int"),
        ).otherwise(F.substring(digits, i, F.lit(1)).cast("int")),
    )
    return (total % 10) == 0


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of the base kinds whose check holds."""
    number = text.rlike("[0-9]")
    parts = lambda s: F.split(s["hit"], r"\.")
    return {
        "email": spans_where(F.contains(text, F.lit("@")), text, EMAIL),
        "ip": F.filter(
            spans_where(number, text, IP),
            lambda s: F.forall(
                parts(s),
                lambda p: F.regexp_replace(p, "^0+(?=.)", "").rlike("^([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"),
            ),
        ),
        "card": F.filter(
            spans_where(number, text, CARD),
            lambda s: (F.char_length(_digits(s["hit"])) <= 19) & _luhn(_digits(s["hit"])),
        ),
        "phone": F.filter(
            spans_where(F.contains(text, F.lit("+")), text, PHONE),
            lambda s: F.char_length(_digits(s["hit"])).between(9, 15),
        ),
    }


BASE = ("email", "ip", "card", "phone")


def _features(span: Column, rank: int) -> dict[str, Column]:
    """Format of a proposed span and the words around it, as numbers."""
    hit, before, after = span["hit"], span["before"], span["after"]
    near = F.lower(F.concat_ws(" ", before, after))
    number = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    count = lambda s, p: (F.char_length(s) - F.char_length(F.regexp_replace(s, p, ""))).cast("double")
    said = lambda words: number(near.rlike(rf"(?<![a-z])(?:{words})"))
    return {
        "kind": F.lit(float(rank)),
        "digits": count(hit, "[0-9]"),
        "letters": count(hit, "[A-Za-z]"),
        "upper": count(hit, "[A-Z]"),
        "other": count(hit, "[^A-Za-z0-9 ]"),
        "brackets": count(hit, r"[\[\](){}@]"),
        "luhn": number(F.when(F.char_length(_digits(hit)).between(8, 25), _luhn(_digits(hit)))),
        "mail": said("e-?mail|mail|contact|write|reach|correo|courriel"),
        "phone": said("phone|tel|call|fax|mobile|cell|whatsapp|dial"),
        "identity": said("ssn|social|passport|national|id(?![a-z])|licen[cs]e|tax"),
        "bank": said("iban|bank|account|card|credit|konto|compte|cuenta"),
        "plain": said("order|invoice|isbn|page|version|part|item|total|figure|room|chapter|meet|look|arriv"),
        "glued": number(before.rlike(r"[A-Za-z0-9/_=#&-]$") | after.rlike(r"^[A-Za-z0-9/_=#&-]")),
    }


def _proposals(text: Column, taken: Column | None) -> dict[str, Column]:
    """Spans of every further generator that no base span covers."""
    found = {}
    for kind, pattern in PROPOSED.items():
        gate = text.rlike(GATES[kind])
        proposed = spans_with_context(gate, text, pattern)
        if taken is not None:
            proposed = F.filter(
                proposed,
                lambda s: ~F.exists(taken, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])),
            )
        found[kind] = proposed
    return found


def _random(salt: int, n: int) -> Column:
    return F.pmod(F.xxhash64(F.col("id"), F.lit(salt)), F.lit(n)).cast("int")


def _pick(salt: int, *values: str) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), _random(salt, len(values)) + 1)


def _number(salt: int, digits: int) -> Column:
    return F.lpad(_random(salt, 10**digits).cast("string"), digits, "0")


def labelled_texts(spark: SparkSession, rows: int = TRAINING_ROWS) -> DataFrame:
    """Texts with one span each: personal (label 1) or only alike (label 0), by format and context."""
    name = F.concat(_pick(1, "anna", "j.smith", "maria", "li.wei", "o-brien"), _number(2, 2))
    host = _pick(3, "example", "mail-box", "corp", "uni-lab")
    personal = {
        "email_text": F.concat(name, _pick(4, " [at] ", " (at) ", " at ", " @ "), host, _pick(5, " [dot] ", " dot ", ".", " (dot) "), _pick(6, "com", "org", "net", "de")),
        "phone_local": F.concat(_pick(4, "(", ""), _number(7, 3), _pick(5, ") ", ") ", ")-"), _number(8, 3), F.lit("-"), _number(9, 4)),
        "national_id": F.concat(_number(7, 3), F.lit("-"), _number(8, 2), F.lit("-"), _number(9, 4)),
        "iban": F.concat(_pick(4, "DE", "FR", "ES"), _number(7, 2), F.lit(" "), _number(8, 4), F.lit(" "), _number(9, 4), F.lit(" "), _number(10, 4), F.lit(" "), _number(11, 4)),
        "long_number": F.concat(_number(7, 3), F.lit("-"), _number(8, 3), F.lit("-"), _number(9, 5)),
    }
    alike = {
        "email_text": F.concat(_pick(1, "look", "meet", "arrived", "the show", "stay"), F.lit(" at "), _pick(3, "noon", "home", "example", "the end"), _pick(5, ". ", " dot "), _pick(6, "Then", "Com", "We", "Net")),
        "phone_local": F.concat(_number(7, 4), _pick(4, "-", "/", "."), _number(8, 3), F.lit("."), _number(9, 3)),
        "national_id": F.concat(_number(7, 3), F.lit("-"), _number(8, 2), F.lit("-"), _number(9, 4)),
        "iban": F.concat(_pick(4, "AB", "XZ", "ID"), _number(7, 2), _number(8, 4), _number(9, 4), _number(10, 4)),
        "long_number": F.concat(_number(7, 5), _number(8, 5), _pick(4, "", "7", "21")),
    }
    lead = {
        "email_text": _pick(12, "e-mail: ", "contact ", "write to ", "reach me under "),
        "phone_local": _pick(12, "phone ", "tel. ", "call me: ", "fax "),
        "national_id": _pick(12, "ssn ", "social security ", "tax id ", "passport "),
        "iban": _pick(12, "iban ", "bank account ", "konto ", "my account "),
        "long_number": _pick(12, "account ", "bank ", "credit card ", "ssn "),
    }
    other = _pick(13, "order ", "invoice no. ", "see page ", "version ", "part ", "item ")
    kinds = list(PROPOSED)
    kind = F.col("id") % len(kinds)
    pick = lambda values: F.coalesce(*[F.when(kind == i, values[k]) for i, k in enumerate(kinds)])
    # A third of either class stands without a telling word; then only the format counts.
    told = _random(14, 3) > 0
    good = F.concat(F.when(told, pick(lead)).otherwise(F.lit("and so ")), pick(personal), F.lit(" as said"))
    bad = F.concat(F.when(told, other).otherwise(F.lit("and so ")), pick(alike), F.lit(" as said"))
    label = (_random(15, 2) == 0).cast("double")
    return spark.range(0, rows, 1, 1).select("id", label.alias("label"), F.when(label == 1, good).otherwise(bad).alias("text"))


class PiiModel:
    """Boosted trees, as weights and nested splits over ``FEATURES``, and a threshold per kind."""

    def __init__(self, trees: list, thresholds: dict[str, float]):
        self.trees, self.thresholds = trees, thresholds

    def accepts(self, kind: str) -> Callable[[Column], Column]:
        rank = list(PROPOSED).index(kind)

        def accepted(s: Column) -> Column:
            values = F.struct(*[v.alias(n) for n, v in _features(s, rank).items()])
            # A lambda over one element binds the features once for all trees.
            return F.exists(F.array(values), lambda x: _margin(self.trees, x) >= self.thresholds[kind])

        return accepted


def _margin(trees: list, x: Column) -> Column:
    total = F.lit(0.0)
    for weight, tree in trees:
        total = total + weight * _tree_column(tree, x)
    return total


def _tree_column(tree, x: Column) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    name, threshold, left, right = tree
    return F.when(x[name] <= threshold, _tree_column(left, x)).otherwise(_tree_column(right, x))


def _tree(node):
    """Leaf value, or (feature, threshold, left, right)."""
    if node.getClass().getSimpleName() == "LeafNode":
        return float(node.prediction())
    split = node.split()
    return FEATURES[split.featureIndex()], float(split.threshold()), _tree(node.leftChild()), _tree(node.rightChild())


def train(spark: SparkSession, labelled: DataFrame | None = None) -> PiiModel:
    """Fit the trees on two thirds of the labelled texts and calibrate on the rest."""
    texts = labelled_texts(spark) if labelled is None else labelled
    found = _proposals(F.col("text"), None)
    rows = None
    for rank, kind in enumerate(PROPOSED):
        hits = texts.select("id", "label", F.explode(found[kind]).alias("s"))
        part = hits.select("id", "label", *[v.alias(n) for n, v in _features(F.col("s"), rank).items()])
        rows = part if rows is None else rows.unionByName(part)
    rows = pin(VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(rows).coalesce(1))
    held = F.pmod(F.xxhash64("id"), F.lit(3)) == 0
    model = GBTClassifier(featuresCol="x", labelCol="label", maxIter=ITERATIONS, maxDepth=DEPTH, seed=7).fit(rows.filter(~held))
    trees = [(float(w), _tree(t.rootNode())) for w, t in zip(model.treeWeights, model._java_obj.trees())]
    x = F.struct(*[F.col(n) for n in FEATURES])
    scored = rows.filter(held).select("kind", "label", F.round(_margin(trees, x), 2).alias("m"))
    # A few hundred rows: margins in hundredths per kind of the labelled texts.
    counts = scored.groupBy("kind", "m").agg(F.sum("label").alias("good"), F.count(F.lit(1)).alias("all")).collect()
    thresholds = {}
    for rank, kind in enumerate(PROPOSED):
        good = total = 0.0
        best = float("inf")
        for row in sorted((r for r in counts if r["kind"] == rank), key=lambda r: -r["m"]):
            good, total = good + row["good"], total + row["all"]
            if row["m"] > 0 and (good + 1) / (total + 2) >= PRECISION:
                best = row["m"] - 0.005
        thresholds[kind] = best
    return PiiModel(trees, thresholds)


def find_personal_data(docs: DataFrame, model: PiiModel) -> DataFrame:
    """Add the spans of each base kind as ``base`` and all accepted ones as ``found``.

    Both are arrays of ``struct<start, rank, end, kind>``. Columns of the input
    with these names are replaced.
    """
    kept = [c for c in docs.columns if c not in ("base", "found")]
    text = F.coalesce(F.col("text"), F.lit(""))
    base = base_spans(text)
    first = docs.select(
        *kept,
        F.concat(*[ranked(base[k], i, k) for i, k in enumerate(BASE)]).alias("base"),
    )
    more = _proposals(text, F.col("base"))
    # Every generator needs a digit, or "at" or "@" set off: most texts pass on at once.
    likely = text.rlike(r"[0-9]|(?i)[\x20\[({](?:at|@)[\x20\])}]")
    added = F.concat(
        *[
            ranked(F.filter(more[k], model.accepts(k)), len(BASE) + i, k)
            for i, k in enumerate(PROPOSED)
        ]
    )
    return first.select(*kept, "base", F.concat("base", F.when(likely, added).otherwise(F.slice("base", 1, 0))).alias("found"))


def redact(found: DataFrame) -> DataFrame:
    """Replace every found span by its kind in brackets; overlapping spans by the first one's."""
    text = F.coalesce(F.col("text"), F.lit(""))
    walked = F.aggregate(
        F.sort_array("found"),
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(
                s["start"] >= acc["at"],
                F.concat(
                    acc["out"],
                    F.array(
                        F.substring(F.col("text"), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")),
                        F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")),
                    ),
                ),
            )
            .otherwise(acc["out"])
            .alias("out"),
        ),
        lambda acc: F.concat(
            F.array_join(acc["out"], ""),
            F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.char_length(text)),
        ),
    )
    cleaned = F.when(F.size("found") > 0, walked).otherwise(F.col("text"))
    return found.withColumn("text", cleaned).drop("base", "found")
