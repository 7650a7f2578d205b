"""Column functions on text: extensions, tokenizers, stop words, spans and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Common English function words, with the pieces that contractions leave.
STOP_WORDS = (
    "a about above after again against ain all am an and any are aren as at be because been before being below between both but by can couldn d did didn do does doesn doing don down during each few for from further "
    "had hadn has hasn have haven having he her here hers herself him himself his how i if in into is isn it its itself just ll m ma me mightn more most mustn my myself needn no nor not now o of off on once only or other our ours ourselves out over own "
    "re s same shan she should shouldn so some such t than that the their theirs them themselves then there these they this those through to too under until up ve very was wasn we were weren what when where which while who whom why will with won wouldn y you your yours yourself yourselves"
).split()
#: Files that are never read, by extension.
SKIPPED = ".png .jpg .jpeg .gif .bmp .ico .webp .pdf .zip .tar .gz .whl .so .dylib .dll".split()
BOOSTED_DOCS = ".md .txt .rst".split()
CODE_TOKEN, TEXT_TOKEN = "[a-z0-9_]+", "[a-záéíóúñ0-9]+"


def suffix(path: Column) -> Column:
    """The extension with its dot, case kept; empty without one and for names that only begin with a dot."""
    return F.regexp_extract(path, "[^/](\\.[^./]+)$", 1)


def route(path: Column) -> Column:
    """py, other or skip."""
    ext = suffix(path)
    return F.when(ext == ".py", "py").when(ext.isin(*SKIPPED) | path.endswith(".DS_Store"), "skip").otherwise("other")


def code_tokens(text: Column) -> Column:
    """Camel case split at its humps, lower case, runs of letters, digits and underscores."""
    humps = F.regexp_replace(F.regexp_replace(text, "(?<=[a-z])(?=[A-Z])", " "), "(?<=[A-Z])(?=[A-Z][a-z])", " ")
    return F.regexp_extract_all(F.lower(humps), F.lit(CODE_TOKEN), F.lit(0))


def text_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TEXT_TOKEN), F.lit(0))


def tokens(text: Column, is_code: Column) -> Column:
    return F.when(is_code, code_tokens(text)).otherwise(text_tokens(text))


def without_stop_words(terms: Column, stop: list[str] = STOP_WORDS) -> Column:
    """Order and repeats stay."""
    return F.filter(terms, lambda t: ~t.isin(*stop))


def query_terms(question: Column) -> Column:
    """Both tokenizers' terms, each once, then without stop words."""
    return without_stop_words(F.array_distinct(F.concat(code_tokens(question), text_tokens(question))))


def piece(text: Column, first: Column, last: Column) -> Column:
    """Characters first to last, half open."""
    return F.substring(text, first + 1, last - first)


def search_key(k: Column, query: Column) -> Column:
    return F.when(k.isNull() | (k == 0), query).otherwise(F.concat_ws("::", k.cast("string"), query))


def json_text(text: Column) -> Column:
    """A JSON string, with quotes, backslashes, line ends and control characters escaped; other characters stand for themselves. null for null."""
    whole = F.to_json(F.array(text), {"ignoreNullFields": "false"})
    return F.substring(whole, F.lit(2), F.length(whole) - 2)


def answer_key(query: Column, k: Column, model: Column, max_tokens: Column, system: Column, context: Column) -> Column:
    """A JSON array of the call's parameters and a short digest of its prompt."""
    digest = F.substring(F.sha2(F.concat(system, context), 256), 1, 12)
    return F.concat(F.lit("["), json_text(query), F.lit(", "), k.cast("string"), F.lit(", "), json_text(model), F.lit(", "), max_tokens.cast("string"), F.lit(', "'), digest, F.lit('"]'))
