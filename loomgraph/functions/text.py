"""Column expressions over text: tokens, counts, keys, rules. All JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of a question that carry no retrieval signal.
STOPWORDS = (
    "a", "an", "the", "and", "or", "of", "for", "in", "on", "to", "with",
    "at", "by", "from", "is", "are", "was", "were", "be", "been", "it", "its",
    "this", "that", "these", "those", "my", "your", "our", "their", "me", "us",
    "him", "her", "them", "you", "we", "they", "i", "what", "which", "who",
    "how", "why", "when", "where", "can", "could", "would", "should", "does",
    "do", "did", "tell", "about", "not", "no", "any", "all", "vault", "notes",
    "note",
)
# Marks of a question about the whole corpus.
OVERVIEW_MARKERS = ("overview", "summar", "topic", "structure", "contents")
SEP = " › "
FRONTMATTER = r"(?s)\A---[ \t]*\r?\n(.*?\r?\n)??---[ \t]*(\r?\n|\z)"


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it in ``body`` many times."""
    return F.transform(F.array(value), body)[0]


def trimmed(text: Column) -> Column:
    """Both ends without any white space (plain ``trim`` knows U+0020 only)."""
    return F.regexp_replace(text, r"\A\s+|\s+\z", "")


def strip_frontmatter(content: Column) -> Column:
    return F.regexp_replace(content, FRONTMATTER, "")


def significant_tokens(text: Column, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0))
    return F.array_except(F.filter(found, lambda w: F.length(w) >= 2), F.array(*map(F.lit, stopwords)))


def word_tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.regexp_replace(text, r"[^A-Za-z0-9_\s]", " ")), r"\s+"), lambda w: w != "")


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def first_words(text: Column, n: Column | int) -> Column:
    """The first n words, one blank apart; nothing for n of 0 or less."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.array_join(F.slice(words(text), F.lit(1), F.greatest(n, F.lit(0))), " ")


def estimate_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 4).cast("long")


def fill_template(template: str, values: dict[str, Column]) -> Column:
    """``{name}`` placeholders filled from columns; unknown ones stay."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def strip_model_wrapping(text: Column) -> Column:
    """A completion without its reasoning block and one outer code fence."""
    plain = trimmed(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""))
    return F.regexp_replace(plain, r"(?s)\A```[a-zA-Z]*[ \t]*\n(.*?)\n?```\z", "$1")


def classify_note(path: Column, title: Column, kind: Column, tags: Column) -> Column:
    """moc, then root (no folder), then regular."""
    moc = F.lower(title).contains("moc") | (F.lower(kind) == "moc") | F.exists(tags, lambda t: F.lower(t) == "moc")
    return F.when(F.coalesce(moc, F.lit(False)), "moc").when(~path.contains("/"), "root").otherwise("regular")


def normalize_type(kind: Column) -> Column:
    clean = F.regexp_replace(F.regexp_replace(F.lower(kind), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit("concept"))


def normalize_relation(relation: Column) -> Column:
    clean = F.regexp_replace(F.regexp_replace(F.lower(relation), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.concat(F.lit("semantic:"), F.coalesce(F.nullif(clean, F.lit("")), F.lit("related_to")))


def is_overview(question: Column) -> Column:
    marked = F.lower(question).rlike("|".join(OVERVIEW_MARKERS))
    return (F.size(significant_tokens(question)) == 0) | marked


def top_folder(path: Column) -> Column:
    return F.when(path.contains("/"), F.substring_index(path, "/", 1)).otherwise("")


def folder_of(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*\z", "")


def title_of(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.md\z", "")


def short_key(text: Column) -> Column:
    """First 16 hex digits of md5 of the lower-cased text: ids of entities and communities."""
    return F.substring(F.md5(F.lower(text)), 1, 16)


def file_of(node_key: Column) -> Column:
    return F.substring_index(node_key, "::", 1)


def ancestors(folder: Column) -> Column:
    """All prefixes of a folder path, the folder itself last; none for the root."""
    parts = F.filter(F.split(folder, "/"), lambda p: p != "")
    return F.transform(F.when(F.size(parts) > 0, F.sequence(F.lit(1), F.size(parts))).otherwise(F.array().cast("array<int>")), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two double arrays; 0 for a zero vector. For sets of pairs; searches use the
    numpy form in ``operators.vectors``."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    both = norm(a) * norm(b)
    return F.when(both > 0, dot / both).otherwise(F.lit(0.0))
