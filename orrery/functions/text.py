"""Text functions over columns: the code tokenizer, query classification, identifiers, normal forms. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that the code tokenizer drops.
STOP_WORDS = (
    "the a an is are was were be been being have has had do does did will would could should may might shall can need dare ought "
    "used to of in for on with at by from this that these those it its my your our var let const nil null none true false"
).split()

# What makes a query a keyword query (any case), the one pattern that minds case, what makes it a question.
KEYWORD = [
    r"\b(function|func|def|class|struct|interface|type)\s+\w+", r"\b(import|from|require|include)\s+",
    r"\b(get|set|create|delete|update|find|search)\w*\b", r"\w+_\w+", r"\.\w+\(", r'\"[^\"]+\"',
]
KEYWORD_CASED = r"[A-Z][a-z]+[A-Z]"
SEMANTIC = [
    r"\b(how|what|why|where|when|explain|describe)\b", r"\b(works|implemented|designed|architecture|flow|logic)\b",
    r"\b(best practice|pattern|approach|strategy)\b", r"\b(similar|related|like|equivalent)\b",
]
DEPENDENCY = r"\b(import\s+graph|call\s+graph|dependency|dependencies|who\s+calls|transitive|package\s+graph|module\s+graph)\b"
QUESTION_STOP_WORDS = "what is the a an how why in to and or of for are do does".split()
LANGUAGE_OF = {".py": "python", ".go": "go", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".java": "java", ".rs": "rust", ".rb": "ruby"}


def camel_split(text: Column) -> Column:
    """getUserById -> get User By Id."""
    return F.regexp_replace(F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")


def tokens(text: Column) -> Column:
    """Tokens of text as it is, split at camel humps, and split at underscores, each lower-cased; plain words come three times."""
    words = lambda form: F.filter(F.split(form, r"[^\p{L}\p{N}_]+"), lambda t: t.rlike("^[a-z][a-z0-9]+$") & ~t.isin(STOP_WORDS))
    forms = F.concat_ws(" ", F.lower(text), F.lower(camel_split(text)), F.lower(F.translate(text, "_", " ")))
    # Without a hump or an underscore the three forms are one.
    return F.when(text.rlike("[a-z][A-Z]|[A-Z][A-Z][a-z]|_"), words(forms)).otherwise(F.flatten(F.array_repeat(words(F.lower(F.coalesce(text, F.lit("")))), 3)))


def normal_question(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def preprocess_query(text: Column) -> Column:
    """Distinct words of the query and of its camel, snake and dot forms, in order."""
    forms = F.concat_ws(" ", text, camel_split(text), F.translate(text, "_", " "), F.translate(text, ".", " "))
    return F.array_join(F.array_distinct(F.filter(F.split(forms, r"\s+"), lambda w: w != "")), " ")


def identifiers(text: Column) -> Column:
    """camelCase, PascalCase, snake_case and dotted names, each once."""
    patterns = [r"\b[a-z]+(?:[A-Z][a-z]+)+\b", r"\b[A-Z][a-z]+(?:[A-Z][a-z]+)+\b", r"\b[a-z]+(?:_[a-z]+)+\b", r"\b\w+\.\w+(?:\.\w+)*\b"]
    return F.array_distinct(F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in patterns]))


def keyword_weight(text: Column) -> Column:
    """Weight of BM25 in the fusion; the vectors' weight is 1 less this."""
    hits = lambda patterns, flag: sum((text.rlike(flag + p).cast("int") for p in patterns), F.lit(0))
    kw, sem = hits(KEYWORD, "(?i)") + text.rlike(KEYWORD_CASED).cast("int"), hits(SEMANTIC, "(?i)")
    n = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    kw = kw + F.when((n <= 3) & (kw > 0), 2).otherwise(0)
    sem = sem + F.when((n > 6) & (sem > 0), 2).otherwise(0)
    return F.when(kw + sem == 0, F.lit(0.3)).otherwise(F.round(F.lit(0.2) + F.lit(0.4) * kw / (kw + sem), 2))


def intent(text: Column) -> Column:
    q, w = F.trim(F.coalesce(text, F.lit(""))), None
    w = keyword_weight(q)
    return F.when(q == "", "hybrid").when(q.rlike("(?i)" + DEPENDENCY), "dependency").when(F.round(1 - w, 2) >= 0.72, "semantic").when(w >= 0.48, "keyword").otherwise("hybrid")


def plain_words(text: Column) -> Column:
    """Distinct words without punctuation, lower-cased (the evaluation's tokenizer)."""
    return F.filter(F.array_distinct(F.split(F.regexp_replace(F.lower(text), r"(?U)[^\w\s]", ""), r"\s+")), lambda w: w != "")


def language_of(path: Column) -> Column:
    out = F.lit("unknown")
    for ext, lang in reversed(LANGUAGE_OF.items()):
        out = F.when(path.endswith(ext), lang).otherwise(out)
    return out


def normal_terms(text: Column) -> Column:
    """The text, and after it its camel and snake case forms split into words, if that differs in more than case."""
    split = F.translate(camel_split(text), "_", " ")
    return F.when(F.lower(split) != F.lower(text), F.concat_ws(" ", text, split)).otherwise(text)


def stamped(line: Column) -> Column:
    """The time at the start of a log line, or null."""
    return F.try_to_timestamp(F.regexp_extract(line, r"^(\d{4}-\d\d-\d\d[ T]\d\d:\d\d:\d\d)", 1), F.lit("yyyy-MM-dd HH:mm:ss"))


def uuid5(space: str, name: Column) -> Column:
    """Name-based UUID, version 5. space: the name space's UUID."""
    h = F.sha1(F.concat(F.unhex(F.lit(space.replace("-", ""))), name.cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))
