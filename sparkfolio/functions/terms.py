"""Search terms: words and their stems, trigrams, similarities, fragments."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: English words that are not searched for.
STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its
itself they them their theirs themselves what which who whom this that these those am is are was were be been being
have has had having do does did doing a an the and but if or because as until while of at by for with about against
between into through during before after above below to from up down in out on off over under again further then once
here there when where why how all any both each few more most other some such no nor not only own same so than too very
s t can will just don should now
""".split()

_VOWEL = "[aeiouy]"
_SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_SAME = frozenset("sky news howe atlas cosmos bias andes inning outing canning herring earring proceed exceed succeed".split())
_STEP_2 = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less"}
_STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP_4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize".split()
#: Endings of the three steps, the longest first.
_ENDS_2, _ENDS_3, _ENDS_4 = (tuple(sorted(ends, key=len, reverse=True)) for ends in ([*_STEP_2, "ogi", "li"], [*_STEP_3, "ative"], [*_STEP_4, "ion"]))


def _short(word: str) -> bool:
    """Whether a word ends in a short syllable."""
    return bool(re.search(r"(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$", word))


def _regions(word: str) -> tuple[int, int]:
    """Where the regions begin that follow the first, and the second, consonant after a vowel."""
    if m := re.match("(?:gener|commun|arsen)", word):
        first = m.end()
    else:
        m = re.search(f"{_VOWEL}[^aeiouy]", word)
        first = m.end() if m else len(word)
    m = re.search(f"{_VOWEL}[^aeiouy]", word[first:])
    return first, first + m.end() if m else len(word)


@lru_cache(100_000)
def stem(word: str) -> str:
    """English stem of a lower-case word, by the rules of the second Porter stemmer."""
    if len(word) < 3 or not re.fullmatch("[a-z']+", word):
        return word
    if word in _SPECIAL:
        return _SPECIAL[word]
    if word in _SAME:
        return word
    word = re.sub(r"^y|(?<=[aeiouy])y", "Y", word.lstrip("'"))
    r1, r2 = _regions(word)
    word = re.sub("(?:'s'|'s|')$", "", word)
    # plurals
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and re.search(f"{_VOWEL}.*.s$", word):
        word = word[:-1]
    if word in _SAME:
        return word
    # past and gerund
    if m := re.search("eed(?:ly)?$", word):
        if m.start() >= r1:
            word = word[: m.start()] + "ee"
    elif (m := re.search("(?:ed|edly|ing|ingly)$", word)) and re.search(_VOWEL, word[: m.start()]):
        word = word[: m.start()]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", word):
            word = word[:-1]
        elif r1 >= len(word) and _short(word):
            word += "e"
    word = re.sub("(?<=.)(?<![aeiouy])[yY]$", lambda m: "i" if m.start() > 1 else m[0], word)
    # derivations
    for ending in _ENDS_2 if word.endswith(_ENDS_2) else ():
        if word.endswith(ending):
            at = len(word) - len(ending)
            if at >= r1:
                if ending == "ogi":
                    word = word[:-1] if word[at - 1 : at] == "l" else word
                elif ending == "li":
                    word = word[:-2] if re.search("[cdeghkmnrt]li$", word) else word
                else:
                    word = word[:at] + _STEP_2[ending]
            break
    for ending in _ENDS_3 if word.endswith(_ENDS_3) else ():
        if word.endswith(ending):
            at = len(word) - len(ending)
            if ending == "ative":
                word = word[:at] if at >= r2 else word
            elif at >= r1:
                word = word[:at] + _STEP_3[ending]
            break
    for ending in _ENDS_4 if word.endswith(_ENDS_4) else ():
        if word.endswith(ending):
            at = len(word) - len(ending)
            if at >= r2 and (ending != "ion" or word[at - 1] in "st"):
                word = word[:at]
            break
    if word.endswith("e"):
        at = len(word) - 1
        if at >= r2 or at >= r1 and not _short(word[:-1]):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.lower()


def stem_head(lexeme: str) -> str:
    """Letters that every word of this stem begins with: no rule puts other new ones at the end than two of e, i, l and y."""
    return lexeme[:1] + re.sub("[eily]{0,2}$", "", lexeme[1:], count=1)


@F.pandas_udf(T.StringType())
def stems(words: pd.Series) -> pd.Series:
    """Stem of each word; apply it to distinct words."""
    return words.map(stem, na_action="ignore")


def words(text: Column) -> Column:
    """Lower-case words of a text in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)(\w+)"), F.lit(1))


def trigrams(text: Column) -> Column:
    """Trigrams of a text's words in order, each word with two blanks before and one after it."""
    padded = F.transform(words(text), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda k: F.substring(w, k, F.lit(3)))))


def similarity(a: Column, b: Column) -> Column:
    """Share of common trigrams among all of two texts; 0 without any."""
    x, y = F.array_distinct(trigrams(a)), F.array_distinct(trigrams(b))
    both, either = F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))
    return F.when(either > 0, both / either).otherwise(0.0)


def trigram_list(text: str | None) -> list[str]:
    """Trigrams of one text, as trigrams() has them."""
    out = []
    for word in re.findall(r"\w+", (text or "").lower()):
        padded = f"  {word} "
        out += [padded[k : k + 3] for k in range(len(padded) - 2)]
    return out


def best_extent(wanted: set[str], there: list[str]) -> float:
    """Largest share of ``wanted`` among the trigrams of a run of ``there``.

    Only runs that begin and end with a wanted trigram can be best, and none longer than wanted / best so far. A run in
    which its first trigram comes again holds a shorter one that is as good, so each run ends before that: the runs from
    one trigram's places do not overlap, and the work is at most that of len(wanted) walks through the text.
    """
    if not wanted:
        return 0.0
    at = [k for k, g in enumerate(there) if g in wanted]
    present = len({there[k] for k in at})
    again, seen = {}, {}
    for k in reversed(at):
        again[k] = seen.get(there[k], len(there))
        seen[there[k]] = k
    best = 0.0
    for i, first in enumerate(at):
        run: set[str] = set()
        common = 0
        last = first - 1
        for j in range(i, len(at)):
            if at[j] >= again[first]:
                break
            for k in range(last + 1, at[j] + 1):
                g = there[k]
                if g not in run:
                    run.add(g)
                    common += g in wanted
            last = at[j]
            best = max(best, common / (len(wanted) + len(run) - common))
            if common == present or len(wanted) / max(len(wanted), len(run)) < best:
                break
    return best


@F.pandas_udf(T.DoubleType())
def word_similarity(query: pd.Series, text: pd.Series) -> pd.Series:
    """Greatest similarity of a query to any run of a text's trigrams."""
    return pd.Series([best_extent(set(trigram_list(q)), trigram_list(t)) for q, t in zip(query, text)], dtype=float)


def shared_trigrams(query: str, text: Column) -> Column:
    """How many of a query's different trigrams a text has, by built-in functions only.

    word_similarity() is at most this number over that of the query's trigrams.
    """
    spaced = F.concat(F.lit("  "), F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\W+", "  "), F.lit(" "))
    grams = sorted(set(trigram_list(query)))
    count = lambda t: sum((F.contains(t, F.lit(g)).cast("int") for g in grams), F.lit(0))
    return F.element_at(F.transform(F.array(spaced), count), 1)  # the spaced text is made once


def may_share(query: str, text: Column) -> Column:
    """At least shared_trigrams(), by a look for the trigrams without their blanks, wherever they stand."""
    grams = [g.strip() for g in sorted(set(trigram_list(query)))]
    count = lambda t: sum((F.contains(t, F.lit(g)).cast("int") for g in grams), F.lit(0))
    return F.element_at(F.transform(F.array(F.lower(F.coalesce(text, F.lit("")))), count), 1)  # letters are made small once


def headline(terms: list[str], least: int = 5, most: int = 18, fragments: int = 2, short: int = 2, mark: str = "**"):
    """A pandas UDF that gives the best fragments of a text with the terms marked; the text's start without any term.

    A fragment does not begin or end with a word of at most ``short`` signs that is no term, as long as ``least`` words
    are left.
    """
    wanted = frozenset(terms)

    def best(text: str | None) -> str:
        parts = re.findall(r"\w+|[^\w]+", text or "")
        spots = [k for k, p in enumerate(parts) if re.match(r"\w", p)]
        hits = [n for n, k in enumerate(spots) if stem(parts[k].lower()) in wanted]
        if not hits:
            return "".join(parts[: spots[most] if len(spots) > most else len(parts)]).strip()
        chosen: list[tuple[int, int]] = []
        for n in sorted(hits, key=lambda n: (-sum(n <= h < n + most for h in hits), n)):
            start = max(0, min(n - 1, len(spots) - least))
            end = min(len(spots), start + most)
            if all(end <= a or start >= b for a, b in chosen):
                chosen.append((start, end))
            if len(chosen) == fragments:
                break
        hit = set(hits)
        trimmed = []
        for a, b in chosen:
            small = lambda n: n not in hit and len(parts[spots[n]]) <= short
            while b - a > least and small(a):
                a += 1
            while b - a > least and small(b - 1):
                b -= 1
            trimmed.append((a, b))
        chosen = trimmed
        show = lambda p: f"{mark}{p}{mark}" if stem(p.lower()) in wanted else p
        return " ... ".join("".join(show(p) for p in parts[spots[a] : spots[b - 1] + 1]) for a, b in sorted(chosen))

    return F.pandas_udf(lambda texts: texts.map(best), "string")
