"""Column helpers: names, hashes, vectors, tokens, times. All are built-in expressions and stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Endings of company names that stand apart, endings that are attached, and legal forms inside names.
CORPORATE_SUFFIXES = ["b.v.", "bv", "n.v.", "nv", "gmbh", "ltd.", "ltd", "inc.", "inc", "corp.", "corp", "corporation", "llc", "l.l.c.", "group", "holding", "holdings"]
ATTACHED_SUFFIXES = [".com", ".io", ".net", ".org"]
LEGAL_FORMS = ["inc", "ltd", "corp", "llc", "co", "limited", "incorporated", "corporation", "plc", "gmbh", "sa", "srl", "bv", "nv", "ag"]
#: Decay by kind of memory, and the weights of a memory's rank.
DECAY = {"episodic": 0.05, "semantic": 0.005, "procedural": 0.01}
OTHER_DECAY, RECENCY_DECAY = 0.01, 0.02
RANK_WEIGHTS = {"text": 0.5, "importance": 0.3, "recency": 0.2}


def _alternatives(words: list[str]) -> str:
    return "|".join(w.replace(".", "[.]") for w in sorted(words, key=len, reverse=True))


#: For canonical_name(), as a pattern that RE2 and Java read alike.
SUFFIXES = f"(\\s+({_alternatives(CORPORATE_SUFFIXES)})|({_alternatives(ATTACHED_SUFFIXES)}))+$"


def canonical_name(raw: Column) -> Column:
    """Lower case, single spaces, without company endings, however many there are; a name that is nothing else stays."""
    clean = F.trim(F.regexp_replace(F.lower(raw), "\\s+", " "))
    bare = F.trim(F.regexp_replace(clean, SUFFIXES, ""))
    return F.when(bare == "", clean).otherwise(bare)


def normalise_name(name: Column) -> Column:
    """Lower case without legal forms and punctuation, single spaces; the first thousand characters."""
    cut = F.lower(F.substring(name, 1, 1000))
    cut = F.regexp_replace(cut, f"\\b({'|'.join(LEGAL_FORMS)})\\b\\.?", "")
    return F.trim(F.regexp_replace(F.regexp_replace(cut, "[^\\w\\s]", ""), "\\s+", " "))


def content_hash(text: Column) -> Column:
    return F.sha2(F.trim(F.regexp_replace(F.lower(text), "\\s+", " ")), 256)


def fingerprint(name: Column, kind: Column) -> Column:
    """Sixteen hexadecimal digits that name an entity by its name and type."""
    return F.substring(F.sha2(F.concat_ws("|", F.lower(F.trim(name)), F.lower(F.trim(kind))), 256), 1, 16)


def property_hash(props: Column) -> Column:
    """Hash of a map that doesn't depend on its order."""
    pairs = F.array_sort(F.transform(F.map_entries(props), lambda e: F.concat_ws("=", e.key, e.value)))
    return F.substring(F.sha2(F.array_join(pairs, "|"), 256), 1, 16)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is missing, of another length or without direction."""
    length = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (length > 0), dot(a, b) / length)


def cosine_score(a: Column, b: Column) -> Column:
    """Cosine moved to 0..1, the scale of the thresholds."""
    return (F.lit(1.0) + cosine(a, b)) / 2


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets as arrays; 0 where either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def edit_similarity(a: Column, b: Column) -> Column:
    most = F.greatest(F.length(a), F.length(b))
    return F.when(most == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / most)


def token_estimate(text: Column) -> Column:
    """A token for four characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def days_between(earlier: Column, later: Column) -> Column:
    """Days with their fraction, not negative."""
    return F.greatest(F.lit(0.0), (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(86_400_000_000.0))


def importance(base: Column, kind: Column, accessed: Column, count: Column, now: Column) -> Column:
    """A memory's base importance on a forgetting curve, with a bonus for use, 1 at most."""
    rate = F.coalesce(*[F.when(kind == k, v) for k, v in DECAY.items()], F.lit(OTHER_DECAY))
    return F.least(F.lit(1.0), base * F.exp(-rate * days_between(accessed, now)) + F.least(F.lit(0.3), 0.05 * F.log1p(count)))


def recency(accessed: Column, now: Column) -> Column:
    return F.exp(-RECENCY_DECAY * days_between(accessed, now))


def base_importance(source: Column, kind: Column, confidence: Column) -> Column:
    return F.when(source == "user_feedback", 1.0).when(kind == "episodic", 0.4).when(source == "inference", 0.3).when(confidence >= 0.9, 0.8).otherwise(confidence * 0.9)


def normalise_date(value: Column) -> Column:
    """A bare year is its first of January; what isn't a date is null."""
    text = F.trim(value.cast("string"))
    return F.when(text.rlike("^\\d{4}$"), F.try_to_timestamp(F.concat(text, F.lit("-01-01")))).otherwise(F.try_to_timestamp(text))


def _words(name: Column) -> Column:
    return F.split(F.replace(name, F.lit("-"), F.lit("_")), "_")


def _capital(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, 2, 1_000_000)))


def pascal_case(name: Column) -> Column:
    return F.array_join(F.transform(_words(name), _capital), "")


def camel_case(name: Column) -> Column:
    return F.array_join(F.transform(_words(name), lambda w, i: F.when(i == 0, w).otherwise(_capital(w))), "")


def without_keys(props: Column, keys: list[str]) -> Column:
    return F.map_filter(props, lambda k, _: ~k.isin(keys))


def any_word_in(text: Column, query: str) -> Column:
    """Whether a text has any word of the query as a part."""
    words = list(dict.fromkeys(query.lower().split()))
    found = F.lit(False)
    for w in words:
        found = found | F.lower(text).contains(w)
    return found


def contains_ci(text: Column, part: str) -> Column:
    return F.lower(text).contains(part.lower())


def display_label(labels: Column, reserved: tuple[str, ...] = ("__Entity__", "__KGBuilder__")) -> Column:
    """The first label that isn't reserved; Entity where there is none."""
    return F.coalesce(F.try_element_at(F.filter(labels, lambda x: ~x.isin(*reserved)), F.lit(1)), F.lit("Entity"))


def member_id(ids: Column) -> Column:
    """Sixteen hexadecimal digits that name a set of members, whatever their order."""
    return F.substring(F.sha2(F.array_join(F.array_sort(ids), "|"), 256), 1, 16)


def cost(prompt_tokens: Column, completion_tokens: Column, prompt_price: Column, completion_price: Column) -> Column:
    """Cost of a turn from prices for a thousand tokens; null where a count or a price is missing."""
    return ((prompt_price * prompt_tokens + completion_price * completion_tokens) / 1000).cast("decimal(10,6)")


def type_name(value: Column) -> Column:
    """Type of a JSON value held as text."""
    return F.when(value.isNull() | (F.trim(value) == "null"), "null").when(F.trim(value).isin("true", "false"), "boolean").when(value.rlike("^\\s*-?\\d+\\s*$"), "integer").when(value.rlike("^\\s*-?\\d+(\\.\\d+)?([eE][-+]?\\d+)?\\s*$"), "number").when(value.rlike("^\\s*\\["), "array").when(value.rlike("^\\s*\\{"), "object").otherwise("string")


def json_safe(value: Column) -> Column:
    """A value held as text as JSON text: numbers and booleans as they are, NaN and infinities null, other text quoted."""
    text = F.trim(value)
    plain = text.rlike("^-?(0|[1-9]\\d*)(\\.\\d+)?([eE][-+]?\\d+)?$") | text.isin("true", "false", "null")
    lost = value.isNull() | F.lower(text).isin("nan", "inf", "-inf", "infinity", "-infinity")
    quoted = F.substring(F.to_json(F.struct(value.alias("v"))), 6, 1_000_000_000)  # without {"v":
    return F.when(lost, "null").when(plain, text).otherwise(F.substring(quoted, F.lit(1), F.length(quoted) - 1))
