"""Text expressions: stripping, tokens, passage and prompt formats, answer parsing."""
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: white space that a strip removes, also beyond ASCII
_SPACE = "[\\s\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\x1c-\\x1f]+"
_TOKEN = "[\\p{L}\\p{N}_]{2,}"
# Frequent Russian function words, the default stop list of the Cyrillic analyzer.
RUSSIAN_STOPWORDS = (
    "и в во не что он на я с со как а то все она так его но да ты к у же вы за бы по только ее мне было вот от меня еще нет о из ему "
    "теперь когда даже ну вдруг ли если уже или ни быть был него до вас нибудь опять уж вам ведь там потом себя ничего ей может они "
    "тут где есть надо ней для мы тебя их чем была сам чтоб без будто чего раз тоже себе под будет ж тогда кто этот"
).split()
# Frequent English function words.
ENGLISH_STOPWORDS = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()


def strip(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, f"^{_SPACE}", ""), f"{_SPACE}$", "")


def tokens(c: Column, stopwords=()) -> Column:
    """Lower-cased tokens of two and more letters, digits or underscores, without the stop words."""
    found = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(_TOKEN), 0)
    if not stopwords:
        return found
    drop = F.array(*[F.lit(w) for w in stopwords])
    return F.filter(found, lambda t: ~F.array_contains(drop, t))


def passage(title: Column, text: Column, separator: str = ". ") -> Column:
    """title, separator and text; the text alone where there is no title."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.coalesce(title, F.lit("")) != "", F.concat(title, F.lit(separator), text)).otherwise(text)


def role_of(name: Column, kind: Column) -> Column:
    """The prompt role: an explicit name wins; a document is a passage; other kinds have none."""
    return F.coalesce(name, F.when(kind == "query", "query").when(kind.isin("document", "passage"), "passage"))


def prefixed(text: Column, role: Column, query_prefix: str, passage_prefix: str) -> Column:
    """The role's prefix and the stripped text, stripped as a whole; other roles leave the text as it is."""
    def put(p):
        return strip(F.concat(F.lit(p), strip(text)))

    return F.when(role == "query", put(query_prefix)).when(role == "passage", put(passage_prefix)).otherwise(text)


def parse_answer(text: Column) -> Column:
    """struct(answer, reasoning, status) of a yes/no reply: the last line that is not empty decides, else the whole text; no beats yes."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\\r\\n|\\n|\\r"), lambda x: strip(x)), lambda x: x != "")
    last = F.upper(F.coalesce(F.try_element_at(lines, F.lit(-1)), F.lit("")))
    whole = F.upper(F.coalesce(text, F.lit("")))

    def verdict(x):
        return F.when(x.contains("НЕТ"), False).when(x.contains("ДА"), True)

    answer = F.coalesce(verdict(last), verdict(whole))
    reasoning = F.array_join(F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0))), "\n")
    return F.struct(answer.alias("answer"), reasoning.alias("reasoning"), F.when(answer.isNull(), "error").otherwise("ok").alias("status"))


#: defaults of a generation request; a caller's own lists take their place
LENGTHS = ["one sentence", "two or three sentences", "a short paragraph", "a long paragraph"]
SHORT_STYLES = ["background", "persona", "negation", "detailed"]
LONG_STYLES = ["background with a hard filter", "persona with exclusions", "argued negation", "several justified criteria"]


def generation_params(draw_length: Column, draw_style: Column, lengths=LENGTHS, short=SHORT_STYLES, long=LONG_STYLES) -> Column:
    """struct(length, style): a tier by one draw, then a style by another, of the short list for the first half of the tiers."""
    tier = F.floor(draw_length * len(lengths)).cast("int")
    pick = lambda xs, u: F.element_at(F.array(*[F.lit(x) for x in xs]), F.floor(u * len(xs)).cast("int") + 1)
    return F.struct(pick(lengths, draw_length).alias("length"), F.when(tier < len(lengths) // 2, pick(short, draw_style)).otherwise(pick(long, draw_style)).alias("style"))


def chosen_template(templates: dict, kind: Column, **columns: Column) -> Column:
    """The filled template of a row's kind; null for a kind without one."""
    out = F.lit(None).cast("string")
    for name, template in templates.items():
        out = F.when(kind == name, filled(template, **columns)).otherwise(out)
    return out


def stamp(ts: Column) -> Column:
    """A time as result files carry it."""
    return F.date_format(ts, "yyyyMMdd_HHmmss")


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def filled(template: str, **columns: Column) -> Column:
    """A prompt template with {name} places filled by columns; null is empty, and braces in values stay as they are."""
    import re

    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[F.coalesce(columns[x].cast("string"), F.lit("")) if i % 2 else F.lit(x) for i, x in enumerate(parts)])


# Dataset types whose queries carry no instruction.
PLAIN_TYPES = ("rumteb", "en_mteb")


def instructed_query(text: Column, model_type: str, dataset_type: str, instruction: str) -> Column:
    """A query as a model gets it: on plain datasets a causal model's queries end with a generic instruction."""
    if dataset_type in PLAIN_TYPES and model_type == "causal_lm":
        return F.concat(text, F.lit(f" {instruction}"))
    return text


def appended_instruction(text: Column, role: Column, instruction: str) -> Column:
    """Queries, right-stripped, with the instruction behind them; other roles as they are."""
    return F.when(role == "query", strip(F.concat(F.regexp_replace(text, f"{_SPACE}$", ""), F.lit(f" {instruction}")))).otherwise(text)


def plain_prefix(text: Column, role: Column, query_prefix: str, passage_prefix: str) -> Column:
    """An encoder's prefix before the text as it is, nothing stripped."""
    return F.when(role == "query", F.concat(F.lit(query_prefix), text)).when(role == "passage", F.concat(F.lit(passage_prefix), text)).otherwise(text)


def remapped_role(role: Column, known: list) -> Column:
    """The prompt name of a model that knows only some: a passage is a document where that is the known name, and has no prompt where neither is."""
    other = F.lit("passage") if "passage" in known else F.lit("document") if "document" in known else F.lit(None).cast("string")
    return F.when(role == "passage", other).otherwise(role)
