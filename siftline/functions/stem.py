"""The Snowball stemmer for Russian, as the published algorithm states it, in expressions over a column of words.

Each step is a projection of its own, so that later steps refer to a column and not to a growing expression.
"""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOWEL = "[аеиоуыэюя]"
# The endings of the algorithm.  Those of a first list follow а or я, which stay.
GERUND = ("в вши вшись".split(), "ив ивши ившись ыв ывши ывшись".split())
ADJECTIVE = "ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею".split()
PARTICIPLE = ("ем нн вш ющ щ".split(), "ивш ывш ующ".split())
REFLEXIVE = "ся сь".split()
VERB = ("ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно".split(),
        "ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю".split())
NOUN = "а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я".split()
SUPERLATIVE = "ейш ейше".split()
DERIVATIONAL = "ост ость".split()


def ending(endings) -> str:
    """A pattern of the longest of the endings: a search takes the leftmost place, so the longest one that ends the word."""
    return f"(?:{'|'.join(endings)})$"


def steps() -> list:
    """(name, SQL expression) of each step.  word is the lower-cased word; every step refers to those before.

    The expressions are SQL with regexp_extract(text, pattern, group), shared by the engine and by its oracle.
    """
    def found(text, endings):
        return f"regexp_extract({text}, '{ending(endings)}', 0)"

    def cut(text, end):
        return f"substr({text}, 1, length({text}) - length({end}))"

    def after_a(text, end):
        """Whether а or я stands before the ending, within the text."""
        return f"substr({cut(text, end)}, length({cut(text, end)}), 1) IN ('а', 'я')"

    def typed(text, lists, name):
        """The ending that may go: of the second list, or of the first behind а or я; '' if there is none."""
        second = ", ".join(f"'{x}'" for x in lists[1])
        return [(f"{name}_all", found(text, [*lists[0], *lists[1]])),
                (name, f"CASE WHEN {name}_all = '' THEN '' WHEN {name}_all IN ({second}) THEN {name}_all WHEN length({text}) > length({name}_all) AND {after_a(text, name + '_all')} THEN {name}_all ELSE '' END")]

    out = [("w", "replace(word, 'ё', 'е')")]
    # RV is behind the first vowel; R2 behind the first consonant behind a vowel, twice
    out += [("head", f"regexp_extract(w, '^.*?{VOWEL}', 0)"), ("rv0", "substr(w, length(head) + 1, length(w))")]
    out += [("before_r2", f"regexp_extract(w, '^.*?{VOWEL}[^аеиоуыэюя].*?{VOWEL}[^аеиоуыэюя]', 0)")]
    out += [("r2_from", "CASE WHEN before_r2 = '' THEN length(w) ELSE length(before_r2) END")]
    out += typed("rv0", GERUND, "gerund")
    out += [("reflexive", f"CASE WHEN gerund <> '' THEN '' ELSE {found('rv0', REFLEXIVE)} END"), ("rv1", cut("rv0", "reflexive"))]
    out += [("adjective", f"CASE WHEN gerund <> '' THEN '' ELSE {found('rv1', ADJECTIVE)} END"), ("rv2", cut("rv1", "adjective"))]
    out += typed("rv2", PARTICIPLE, "participle")
    out += typed("rv1", VERB, "verb")
    out += [("noun", found("rv1", NOUN))]
    out += [("rv3", f"CASE WHEN gerund <> '' THEN {cut('rv0', 'gerund')} WHEN adjective <> '' THEN {cut('rv2', 'participle')} WHEN verb <> '' THEN {cut('rv1', 'verb')} ELSE {cut('rv1', 'noun')} END")]
    out += [("rv4", "CASE WHEN substr(rv3, length(rv3), 1) = 'и' THEN substr(rv3, 1, length(rv3) - 1) ELSE rv3 END")]
    out += [("derived", found("rv4", DERIVATIONAL))]
    out += [("rv5", f"CASE WHEN derived <> '' AND length(head) + length(rv4) - length(derived) >= r2_from THEN {cut('rv4', 'derived')} ELSE rv4 END")]
    out += [("superlative", found("rv5", SUPERLATIVE)), ("rv6", cut("rv5", "superlative"))]
    double = "length(rv6) > 1 AND substr(rv6, length(rv6) - 1, 2) = 'нн'"
    out += [("rv7", f"CASE WHEN {double} THEN substr(rv6, 1, length(rv6) - 1) WHEN superlative = '' AND substr(rv6, length(rv6), 1) = 'ь' THEN substr(rv6, 1, length(rv6) - 1) ELSE rv6 END")]
    # a word without a vowel has no region: nothing goes
    out += [("stem", "CASE WHEN head = '' THEN w ELSE concat(head, rv7) END")]
    return out


def stemmed(words: DataFrame, column: str = "term") -> DataFrame:
    """words with the column (lower-cased words) replaced by their stems.

    A filter or join on the stem would be pushed below the steps and copy them into one another: write the result first.
    """
    names = words.columns
    rows = words.withColumn("word", F.col(column))
    for name, sql in steps():
        rows = rows.withColumn(name, F.expr(sql))
    return rows.select(*[F.col("stem").alias(c) if c == column else F.col(c) for c in names])


def stem_ctes(source: str, column: str = "word") -> str:
    """The same steps as SQL common table expressions over `source` (word): the last is `stems` (word, stem)."""
    parts, at = [], f"(SELECT DISTINCT {column} AS word FROM {source})"
    for i, (name, sql) in enumerate(steps()):
        parts.append(f"stem{i} AS (SELECT *, {sql} AS {name} FROM {at})")
        at = f"stem{i}"
    return ",\n".join([*parts, f"stems AS MATERIALIZED (SELECT word, stem FROM {at})"])
