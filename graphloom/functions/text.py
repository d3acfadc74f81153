"""Text expressions: token counts, term sets, normalisers, parsers and windows as pure Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.functions.vector import let

#: Fixed values.
ASCII_WORD = r"[a-z0-9_]+"
UNICODE_WORD = r"[\p{L}\p{N}_]+"
LATIN_CYRILLIC = r"[A-Za-zА-Яа-яЁё0-9]+"
FACT_TOKEN = r"[A-Za-z][A-Za-z0-9'.-]*|[0-9]+(?:\.[0-9]+)?"
PLAIN_FACT = r"[a-z0-9]+(?:\.[0-9]+)?"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
EDGE_PUNCTUATION = ".,;:!?()[]{}\"'"
STOPWORDS = ("about", "after", "also", "among", "and", "are", "been", "being", "can", "from", "had", "has", "have", "held", "his", "into", "its", "more", "named", "than", "that", "the", "their", "there", "this", "was", "were", "which", "while", "with")
USER_PREFIXES = ("user_", "user:", "User ", "user ")
DATE_FORMATS = ("MMM d, yyyy", "MMMM d, yyyy", "yyyy-MM-dd")


def approx_tokens(text: Column) -> Column:
    """0 for an empty text, else a third of its characters, one at least."""
    return F.when(F.length(text) == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(F.length(text) / 3))).cast("long")


def estimated_tokens(text: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.length(text) / 4).cast("long")


def chunk_budget(window: int = 8192, ratio: float = 0.75, least: int = 512) -> int:
    return max(least, int(window * ratio))


def chunk_estimate(tokens: Column, budget: int) -> Column:
    return F.ceil(tokens / F.lit(budget)).cast("long")


def all_matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def terms(text: Column, pattern: str = UNICODE_WORD, longer_than: int = 2) -> Column:
    """Distinct lower-cased words longer than a limit, in order of first appearance."""
    found = F.array_distinct(all_matches(F.lower(text), pattern))
    return F.filter(found, lambda x: F.length(x) > longer_than)


def edge_stripped(token: Column) -> Column:
    return F.btrim(token, F.lit(EDGE_PUNCTUATION))


def fact_terms(text: Column, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    """term:<token> of words longer than three or numeric, without stop words, in order of first appearance."""
    tokens = F.transform(all_matches(text, FACT_TOKEN), lambda t: F.lower(edge_stripped(t)))
    kept = F.filter(tokens, lambda t: (F.length(t) > 3) | t.rlike("^[0-9]+$"))
    return F.array_distinct(F.transform(F.filter(kept, lambda t: ~t.isin(*stopwords)), lambda t: F.concat(F.lit("term:"), t)))


def plain_facts(text: Column) -> Column:
    """Lower-case tokens longer than three or numeric, repeats kept."""
    return F.filter(all_matches(F.lower(text), PLAIN_FACT), lambda t: (F.length(t) > 3) | t.rlike("^[0-9]+$"))


def normalized_answer(text: Column) -> Column:
    """Lower case without punctuation and articles, single spaces."""
    tokens = F.split(F.translate(F.lower(text), PUNCTUATION, ""), r"\s+")
    return F.array_join(F.filter(tokens, lambda t: ~t.isin("a", "an", "the", "")), " ")


def normalized_user(text: Column) -> Column:
    """Without a prefix: the first run of digits, else the text; null if empty."""
    bare = F.trim(text)
    for prefix in reversed(USER_PREFIXES):
        bare = F.when(F.trim(text).startswith(prefix), F.substring(F.trim(text), len(prefix) + 1, 2**31 - 1)).otherwise(bare)
    return F.coalesce(F.nullif(F.regexp_extract(bare, r"\d+", 0), F.lit("")), F.nullif(bare, F.lit("")))


def normalized_label(text: Column) -> Column:
    """ham or spam of a label in any case, prefix or quotes; else null."""
    bare = F.btrim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "^label_", ""), "^label:", ""), F.lit(" .'\"[]()"))
    return F.when(bare.isin("ham", "not spam"), "ham").when(bare == "spam", "spam")


def parsed_date(text: Column) -> Column:
    """A time in one of three formats, else null."""
    return F.coalesce(*(F.try_to_timestamp(F.trim(text), F.lit(f)) for f in DATE_FORMATS))


def field(line: Column, name: str) -> Column:
    """The value of ``name: value`` between || marks."""
    return F.nullif(F.trim(F.regexp_extract(line, rf"(?:^|\|\|)\s*{name}:\s*([^|]*)", 1)), F.lit(""))


def record_lines(text: Column) -> Column:
    """Trimmed lines that begin a record."""
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x.startswith("Date:"))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"[.!?…]+|\n+"), lambda x: F.trim(x)), lambda x: x != "")


def slug(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(text), r"(?U)\W+", "_"), F.lit("_"))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"[ \t\n\r\f\x0B]+"), lambda x: x != "")


def word_windows(text: Column, size: int = 160) -> Column:
    """Array of (index, text) windows of ``size`` words; one empty window for an empty text."""
    def cut(w: Column) -> Column:
        count = F.greatest(F.lit(1), F.ceil(F.size(w) / size)).cast("int")
        return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(i.alias("idx"), F.array_join(F.slice(w, i * size + 1, F.lit(size)), " ").alias("text")))

    return let(words(text), cut)


def occurrences(text: Column, needle: Column) -> Column:
    """Offsets of a literal, letter case aside: what lies between its occurrences gives their places."""
    low, key = F.lower(text), F.lower(needle)
    parts = F.split(low, F.concat(F.lit(r"\Q"), key, F.lit(r"\E")), -1)
    gaps = F.slice(parts, F.lit(1), F.size(parts) - 1)
    begin = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out"))

    def step(acc, gap):
        start = acc["at"] + F.length(gap)
        return F.struct((start + F.length(key)).alias("at"), F.concat(acc["out"], F.array(start)).alias("out"))

    return F.when((F.length(key) > 0) & (F.size(parts) > 1), F.aggregate(gaps, begin, step, lambda a: a["out"])).otherwise(F.expr("cast(array() as array<int>)"))


def predicted_values(answer_type: Column, text: Column) -> Column:
    """Values a prediction names, by the kind of answer asked for."""
    lowered = F.lower(text)
    options = F.array(*(F.lit(o) for o in ("more common than", "less common than", "same frequency as", "more common", "less common", "same frequency")))
    prefixed = F.regexp_extract(text, r"(?i)\b(?:Answer|Label|User)\s*:\s*([^\n\r]+)", 1)
    bare = lambda x: F.lower(F.btrim(F.trim(x), F.lit("'\"")))
    return (
        F.when(answer_type.contains("NUMERIC"), all_matches(text, r"-?\d+(?:\.\d+)?"))
        .when(answer_type.contains("USER"), all_matches(text, r"\b\d+\b"))
        .when(answer_type.contains("COMPARISON"), F.filter(options, lambda o: lowered.contains(o)))
        .when(prefixed != "", F.array(bare(prefixed)))
        .otherwise(F.array(bare(text)))
    )


def predicted_label(vocabulary: Column, text: Column) -> Column:
    """The one label of the vocabulary that the text names as a whole word; none if several or no label."""
    lowered = F.lower(text)
    hits = F.array_distinct(F.filter(vocabulary, lambda v: F.regexp_like(lowered, F.concat(F.lit(r"\b\Q"), v, F.lit(r"\E\b")))))
    return F.when(F.size(hits) == 1, hits).otherwise(F.expr("cast(array() as array<string>)"))


def gold_values(text: Column) -> Column:
    """Items of a literal list, else the text itself."""
    listed = F.from_json(F.translate(text, "'", '"'), "array<string>")
    return F.when(F.trim(text).startswith("["), F.coalesce(listed, F.array(text))).otherwise(F.array(F.btrim(text, F.lit("'\""))))


def secret_answer(context: Column) -> Column:
    """What a pattern for a planted code finds in a context, else null."""
    return F.nullif(F.regexp_extract(context, r"(?i)secret (?:code|number|key) (?:is|:)\s*([A-Za-z0-9-]+)", 1), F.lit(""))


def direct_prompt(context: Column, question: Column) -> Column:
    return F.concat_ws("\n\n", F.lit("Answer from the context only."), F.concat(F.lit("Context:\n"), context), F.concat(F.lit("Question: "), question))
