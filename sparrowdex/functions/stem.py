"""The Porter2 English stemmer, after its published definition: of a word, and of a column of words."""

from __future__ import annotations

import re
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

V = "aeiouy"
DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
#: Fixed values of the definition: whole words with stems of their own, words left alone, and endings with what replaces them.
SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
ALONE = {"sky", "news", "howe", "atlas", "cosmos", "bias", "andes"}
AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
STEP2 = [("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", "")]
STEP3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", "")]
STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic"]


def _regions(w: str) -> tuple[int, int]:
    m = re.match("gener|commun|arsen", w)
    if m:
        r1 = m.end()
    else:
        m = re.search(f"[{V}][^{V}]", w)
        r1 = m.end() if m else len(w)
    m = re.search(f"[{V}][^{V}]", w[r1:])
    return r1, r1 + m.end() if m else len(w)


def _short_end(w: str) -> bool:
    return bool(re.search(f"[^{V}][{V}][^{V}wxY]$", w) or re.fullmatch(f"[{V}][^{V}]", w))


def stem(word: str) -> str:
    w = word
    if len(w) <= 2:
        return w
    w = w.removeprefix("'")
    if w in SPECIAL:
        return SPECIAL[w]
    if w in ALONE:
        return w
    w = re.sub(f"(^|[{V}])y", r"\1Y", w)
    r1, r2 = _regions(w)
    for end in ("'s'", "'s", "'"):
        if w.endswith(end):
            w = w[: -len(end)]
            break
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith(("us", "ss")):
        pass
    elif w.endswith("s") and re.search(f"[{V}].+$", w[:-1]):
        w = w[:-1]
    if w in AFTER_1A:
        return w
    if m := re.search("(eedly|eed)$", w):
        if m.start() >= r1:
            w = w[: m.start()] + "ee"
    elif (m := re.search("(ingly|edly|ing|ed)$", w)) and re.search(f"[{V}]", w[: m.start()]):
        w = w[: m.start()]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(DOUBLE):
            w = w[:-1]
        elif _short_end(w) and r1 >= len(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in V:
        w = w[:-1] + "i"
    for end, to in STEP2:
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= r1 and (end != "ogi" or w[at - 1 : at] == "l") and (end != "li" or w[at - 1 : at] in tuple("cdeghkmnrt")):
                w = w[:at] + to
            break
    for end, to in STEP3:
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= r1 and (end != "ative" or at >= r2):
                w = w[:at] + to
            break
    for end in STEP4:
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= r2 and (end != "ion" or w[at - 1 : at] in ("s", "t")):
                w = w[:at]
            break
    if w.endswith("e"):
        at = len(w) - 1
        if at >= r2 or at >= r1 and not _short_end(w[:-1]):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def _ends(w: Column, *ends: str) -> Column:
    found = F.lit(False)
    for e in ends:
        found = found | w.endswith(e)
    return found


def _cut(w: Column, n: Column | int) -> Column:
    return F.substring(w, F.lit(1), F.length(w) - n)


def _longest(ends: list[str]) -> str:
    """A pattern of the longest of these endings: the leftmost place from which one reaches the end is the longest's."""
    return f"({'|'.join(ends)})$"


def _mapped(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def with_stems(rows: DataFrame, col: str) -> DataFrame:
    """rows with the words of a column replaced by stem() of them, null by null. Built-in functions alone, a projection for each step, so
    it runs in generated code where the rows are: no join, no shuffle, no Python worker."""
    names = [c for c in rows.columns]
    word, w, r1, r2, left, end = (F.col(f"`{c}`") for c in (col, "_stem_w", "_stem_r1", "_stem_r2", "_stem_left", "_stem_end"))
    short = f"[^{V}][{V}][^{V}wxY]$|^[{V}][^{V}]$"
    pair = f"^.*?[{V}][^{V}]"
    size = F.length(w)

    def put(**columns: Column) -> None:
        nonlocal rows
        rows = rows.withColumns({f"_stem_{k}": v for k, v in columns.items()})

    put(w=F.when(word.startswith("'") & (F.length(word) > 2), F.substring(word, 2, 1 << 30)).otherwise(word))
    own = F.when(F.length(word) <= 2, word).when(w.isin(*SPECIAL), _mapped(SPECIAL, w)).when(w.isin(*ALONE), w)
    put(own=own, w=F.when(w.contains("y"), F.regexp_replace(w, f"(^|[{V}])y", "$1Y")).otherwise(w))
    put(w=F.when(w.endswith("'s'"), _cut(w, 3)).when(w.endswith("'s"), _cut(w, 2)).when(w.endswith("'"), _cut(w, 1)).otherwise(w))
    plural = F.when(w.endswith("sses"), _cut(w, 2)).when(_ends(w, "ied", "ies"), F.when(size > 4, _cut(w, 2)).otherwise(_cut(w, 1))).when(_ends(w, "us", "ss"), w).when(w.endswith("s") & w.rlike(f"[{V}].+s$"), _cut(w, 1)).otherwise(w)
    put(w=plural)
    put(own=F.coalesce("_stem_own", F.when(w.isin(*AFTER_1A), w)))
    # The regions are asked for only where an ending is left that a step may take; of a word that the steps so far have cut they begin where they did, or beyond its end.
    last = lambda w, n: F.substring(w, -n, n)
    open_ends = sorted({e[-2:] for e in [*dict(STEP2), *dict(STEP3), *STEP4, "ll", "ing", "ed"]})
    needed = last(w, 1).isin("e", "y", "Y") | last(w, 2).isin(*open_ends)
    put(r1=F.when(needed, F.length(F.regexp_extract(w, f"^(gener|commun|arsen|.*?[{V}][^{V}])", 1))).otherwise(0))
    put(r1=F.when(r1 == 0, size).otherwise(r1))
    put(r2=F.when(needed & (r1 < size), F.length(F.regexp_extract(F.substring(w, r1 + 1, size), pair, 0))).otherwise(0))
    put(r2=F.when(r2 == 0, size).otherwise(r1 + r2))
    # Of eed and eedly the ending, of the others what stands before it if that has a vowel.
    put(end=F.when(_ends(w, "eed", "eedly"), F.regexp_extract(w, _longest(["eedly", "eed"]), 1)).otherwise(""))
    put(left=F.when((end == "") & _ends(w, "ing", "ed", "ingly", "edly"), F.regexp_extract(w, f"^(.*[{V}].*?)(?:ingly|edly|ing|ed)$", 1)).otherwise(""))
    mended = F.when(_ends(left, "at", "bl", "iz"), F.concat(left, F.lit("e"))).when(_ends(left, *DOUBLE), _cut(left, 1)).when((r1 >= F.length(left)) & left.rlike(short), F.concat(left, F.lit("e"))).otherwise(left)
    put(w=F.when((end != "") & (size - F.length(end) >= r1), F.concat(_cut(w, F.length(end)), F.lit("ee"))).when(left != "", mended).otherwise(w))
    put(w=F.when(_ends(w, "y", "Y") & w.rlike(f"^.+[^{V}][yY]$"), F.concat(_cut(w, 1), F.lit("i"))).otherwise(w))
    at = size - F.length(end)
    before = F.substring(w, at, F.lit(1))
    for table, allowed in (
        (dict(STEP2), (at >= r1) & ((end != "ogi") | (before == "l")) & ((end != "li") | before.isin(*"cdeghkmnrt"))),
        (dict(STEP3), (at >= r1) & ((end != "ative") | (at >= r2))),
        (dict.fromkeys(STEP4, ""), (at >= r2) & ((end != "ion") | before.isin("s", "t"))),
    ):
        put(end=F.when(last(w, 2).isin(*sorted({e[-2:] for e in table})), F.regexp_extract(w, _longest(list(table)), 1)).otherwise(""))
        put(w=F.when((end != "") & allowed, F.concat(F.substring(w, F.lit(1), at), _mapped(table, end))).otherwise(w))
    last_e = w.endswith("e") & ((size - 1 >= r2) | (size - 1 >= r1) & ~_cut(w, 1).rlike(short))
    put(w=F.when(last_e | w.endswith("ll") & (size - 1 >= r2), _cut(w, 1)).otherwise(w))
    return rows.withColumn(col, F.coalesce("_stem_own", F.when(w.contains("Y"), F.translate(w, "Y", "y")).otherwise(w))).select(*(f"`{c}`" for c in names))
