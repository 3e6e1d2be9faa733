"""Text functions: token counts, lexemes, answer scoring, JSON salvage and rendering."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def token_estimate(text: Column) -> Column:
    """A token for every four bytes begun."""
    return F.ceil(F.octet_length(text) / 4).cast("long")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")).cast("long")


# English stop words of the keyword channel.
STOP_WORDS = (
    "a about above after again against all am an and any are as at be because been before being below between both but by can did do does doing don down during each few for from "
    "further had has have having he her here hers herself him himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or other "
    "our ours ourselves out over own s same she should so some such t than that the their theirs them themselves then there these they this those through to too under until up very "
    "was we were what when where which while who whom why will with you your yours yourself yourselves"
).split()


def words(text: Column) -> Column:
    """Runs of a to z in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)"), 1)


def lexemes(text: Column, stem: bool = True) -> Column:
    """Words without stop words, stemmed where asked."""
    kept = F.filter(words(text), lambda w: ~w.isin(*STOP_WORDS))
    return stemmed(kept) if stem else kept


_VOWEL = re.compile(r"[aeiou]|(?<=[^aeiou])y")


def _measure(stem: str) -> int:
    shape = "".join("v" if c in "aeiou" or (c == "y" and i and stem[i - 1] not in "aeiou") else "c" for i, c in enumerate(stem))
    return len(re.findall("v+c+", shape))


# Suffixes of the published Porter (1980) algorithm, and what takes their place.
STEP_2 = "ational ate,tional tion,enci ence,anci ance,izer ize,abli able,alli al,entli ent,eli e,ousli ous,ization ize,ation ate,ator ate,alism al,iveness ive,fulness ful,ousness ous,aliti al,iviti ive,biliti ble"
STEP_3 = "icate ic,ative ,alize al,iciti ic,ical ic,ful ,ness "
STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def porter(word: str) -> str:
    """The stem of a lower-case English word."""
    if len(word) < 3:
        return word
    has_vowel = lambda s: bool(_VOWEL.search(s))
    doubled = lambda s: len(s) > 1 and s[-1] == s[-2] and s[-1] not in "aeiou"
    cvc = lambda s: bool(re.search(r"[^aeiou][aeiouy][^aeiouwxy]$", s))
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        for end in ("ed", "ing"):
            if word.endswith(end) and has_vowel(word[: -len(end)]):
                word = word[: -len(end)]
                if word.endswith(("at", "bl", "iz")) or (_measure(word) == 1 and cvc(word)):
                    word += "e"
                elif doubled(word) and word[-1] not in "lsz":
                    word = word[:-1]
                break
    if word.endswith("y") and has_vowel(word[:-1]):
        word = word[:-1] + "i"
    for table in (STEP_2, STEP_3):
        for rule in sorted((x.partition(" ") for x in table.split(",")), key=lambda r: -len(r[0])):
            if word.endswith(rule[0]):
                stem = word[: -len(rule[0])]
                word = stem + rule[2] if _measure(stem) > 0 else word
                break
    for end in sorted(STEP_4, key=len, reverse=True):
        if word.endswith(end):
            stem = word[: -len(end)]
            if _measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
                word = stem
            break
    if word.endswith("e") and (_measure(word[:-1]) > 1 or (_measure(word[:-1]) == 1 and not cvc(word[:-1]))):
        word = word[:-1]
    return word[:-1] if _measure(word) > 1 and doubled(word) and word.endswith("l") else word


def stemmed(words: Column) -> Column:
    @F.pandas_udf("array<string>")
    def apply(lists: pd.Series) -> pd.Series:
        memo: dict[str, str] = {}

        def stem(w: str) -> str:
            if w not in memo:
                memo[w] = porter(w)
            return memo[w]

        return lists.map(lambda ws: None if ws is None else [stem(w) for w in ws])

    return apply(words)


_PUNCTUATION = r"[!-/:-@\[-`{-~]"


def normalize_answer(text: Column) -> Column:
    """Lower case, ASCII punctuation as spaces, without a, an and the."""
    parts = F.split(F.regexp_replace(F.lower(text), _PUNCTUATION, " "), r"\s+")
    return F.array_join(F.filter(parts, lambda w: ~w.isin("", "a", "an", "the")), " ")


def token_f1(prediction: Column, truth: Column) -> Column:
    """F1 of the words of two answers as multisets; 1 if neither has any."""
    tokens = lambda c: F.filter(F.split(normalize_answer(c), " "), lambda w: w != "")
    p, t = tokens(prediction), tokens(truth)
    count = lambda ws, w: F.size(F.filter(ws, lambda x: x == w))
    common = F.aggregate(F.array_distinct(t), F.lit(0), lambda s, w: s + F.least(count(p, w), count(t, w)))
    precision, recall = common / F.size(p), common / F.size(t)
    return (
        F.when((F.size(t) == 0) & (F.size(p) == 0), F.lit(1.0))
        .when((F.size(t) == 0) | (F.size(p) == 0) | (common == 0), F.lit(0.0))
        .otherwise(2 * precision * recall / (precision + recall))
    )


def evidence_recall(expected: Column, retrieved: Column) -> Column:
    """The part of the expected ids that were retrieved; 1 if none is expected."""
    want = F.array_distinct(expected)
    return F.when(F.size(want) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(want, retrieved)) / F.size(want))


def evidence_precision(expected: Column, retrieved: Column) -> Column:
    """The part of the retrieved ids that are expected; null if there are neither, 0 if nothing was retrieved."""
    got = F.array_distinct(retrieved)
    return F.when((F.size(got) == 0) & (F.size(expected) == 0), F.lit(None).cast("double")).when(F.size(got) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(got, expected)) / F.size(got))


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def truncated(text: Column, limit: int) -> Column:
    """At most limit characters, with an ellipsis where some are left out."""
    return F.when(F.char_length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def says_yes(text: Column) -> Column:
    return F.startswith(F.lower(F.trim(text)), F.lit("yes"))


def salvage_json(text: str | None) -> str | None:
    """The JSON value in a model's reply: the whole, else what a fence holds, else the first balanced object or array; else null."""
    if text is None:
        return None

    def valid(s: str) -> bool:
        try:
            json.loads(s)
        except ValueError:
            return False
        return True

    if valid(text):
        return text
    fence = re.search(r"```[^\n]*\n?(.*?)(?:```|\Z)", text, re.S)
    body = (fence[1] if fence else text).strip()
    if valid(body):
        return body
    opening = re.search(r"[{\[]", body)
    if not opening:
        return None
    a, z = ("{", "}") if opening[0] == "{" else ("[", "]")
    depth = 0
    # strings count as a whole, so brackets in them don't
    for m in re.finditer(r'"(?:[^"\\]|\\.)*(?:"|\Z)|' + re.escape(a) + "|" + re.escape(z), body[opening.start() :], re.S):
        depth += {a: 1, z: -1}.get(m[0], 0)
        if depth == 0 and m[0] == z:
            found = body[opening.start() : opening.start() + m.end()]
            return found if valid(found) else None
    return None


def json_salvage(text: Column) -> Column:
    @F.pandas_udf("string")
    def apply(texts: pd.Series) -> pd.Series:
        return texts.map(salvage_json)

    return apply(text)


def json_keys_ok(text: Column, allowed: list[str]) -> Column:
    """Whether a JSON object has no keys but the allowed ones."""
    return F.coalesce(F.size(F.array_except(F.json_object_keys(text), F.array(*map(F.lit, allowed)))) == 0, F.lit(False))


def extraction_message(content: Column, timestamp: Column, speaker: Column, context: Column) -> Column:
    """What an extractor is asked: speaker and context where known, the content, and its time."""
    return F.concat(
        F.coalesce(F.concat(F.lit("Speaker: "), speaker, F.lit("\n\n")), F.lit("")),
        F.coalesce(F.concat(F.lit("## Preceding Context\n\n"), context, F.lit("\n\n---\n\n")), F.lit("")),
        F.lit("## Content to Extract From\n\n"), content, F.lit("\n\nTimestamp: "), F.date_format(timestamp, "yyyy-MM-dd'T'HH:mm:ss'+00:00'"),
    )


def occurred(start: Column, end: Column) -> Column:
    """The suffix that says when: one day, from a day to another, or until a day."""
    s, e = F.date_format(start, "yyyy-MM-dd"), F.date_format(end, "yyyy-MM-dd")
    return (
        F.when(s.isNotNull() & e.isNotNull() & (s != e), F.concat(F.lit(" | occurred: "), s, F.lit(" to "), e))
        .when(s.isNotNull(), F.concat(F.lit(" | occurred: "), s))
        .when(e.isNotNull(), F.concat(F.lit(" | occurred: until "), e))
        .otherwise(F.lit(""))
    )


def rerank_input(content: Column, start: Column) -> Column:
    day = F.concat(F.lit("[Date: "), F.date_format(start, "MMMM d, yyyy"), F.lit(" ("), F.date_format(start, "yyyy-MM-dd"), F.lit(")] "))
    return F.concat(F.coalesce(day, F.lit("")), content)


# How a bank's dispositions, from 1 to 5, are put in words.
SKEPTICISM = ["very trusting", "somewhat trusting", "balanced between trust and skepticism", "quite skeptical", "extremely skeptical"]
LITERALISM = ["reads between the lines", "mostly infers implied meaning", "balances literal and implied meaning", "interprets things fairly literally", "interprets everything literally"]
EMPATHY = [
    "focuses purely on logic",
    "mostly focuses on logic with some consideration of feelings",
    "balances logic and emotional factors",
    "gives significant weight to emotional factors",
    "strongly weights emotional factors",
]
BIAS = ["minimally", "moderately", "significantly", "strongly"]


def disposition_text(skepticism: Column, literalism: Column, empathy: Column, bias: Column) -> Column:
    pick = lambda labels, level: F.element_at(F.array(*map(F.lit, labels)), level.cast("int"))
    quarter = F.least(F.floor(bias * 4) + 1, F.lit(4))
    return F.format_string(
        "Your reasoning style: You are %s. You %s. You %s. These traits %s influence your responses.",
        pick(SKEPTICISM, skepticism), pick(LITERALISM, literalism), pick(EMPATHY, empathy), pick(BIAS, quarter),
    )


def directives_text(directives: Column) -> Column:
    rules = F.transform(directives, lambda d, i: F.concat((i + 1).cast("string"), F.lit(". You MUST: "), d))
    return F.when(F.size(directives) > 0, F.concat(F.lit("Hard rules (never violate):\n"), F.array_join(rules, "\n"))).otherwise(F.lit(""))


def is_fatal_error(kind: Column, message: Column) -> Column:
    """Whether an error ends a run: all kinds do but those that a retry may mend; of model errors, client errors except 429, and replies that can't be parsed."""
    text = F.lower(message)
    status = F.try_to_number(F.nullif(F.regexp_extract(text, r"api error \((\d+)", 1), F.lit("")), F.lit("99999")).cast("int")
    refused = status.between(400, 499) & (status != 429)
    unread = text.rlike("failed to parse (openai|anthropic|gemini) response")
    return F.when(kind.isin("llm_no_json", "llm_refusal", "rate_limit", "server_error"), F.lit(False)).when(kind == "llm", F.coalesce(refused, F.lit(False)) | F.coalesce(unread, F.lit(False))).otherwise(F.lit(True))
