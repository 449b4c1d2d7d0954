"""Broken prompt and response pairs, each with its kind of defect.

The kinds are tried in this order, the first that fits decides:

``failed``          the call failed (an error that no retry cured) or the pair holds only the failure placeholder;
``empty``           the answer is missing or only stands for nothing;
``copied_question`` greedy string tiling covers the answer and most of the query;
``refusal``         the answer fits a refusal grammar;
``other_language``  answer or reasoning is in another script or language than the query;
``truncated``       a pushdown parser (fences, brackets, quotations, lists, markup), the end of the reasoning, the field
                    limit of the answer, or the conclusion that the answer only begins show that something is missing.

The pair alone decides: no other field is read but the question's type, which makes "Insufficient information" sound for
a question without an answer. Languages are told by profiles fitted on the corpus' own labelled texts (``language``),
names set aside; without profiles only scripts are compared.

Defined results: rows sent again count once (rows of one id with differing texts: the
least text of each field); null ids are left out; a null or blank query has no language
and copies nothing; null and blank reasoning is no defect by itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .language import Profiles
from .leakage import greedy_tiles, words_of
from .structure import broken_end, list_mark_end, open_elements

PLACEHOLDER = re.compile(r"^\W*(?:inference|generation|call|request)[ _](?:has )?failed\b.{0,60}$", re.I | re.S)
_ERROR = re.compile(r"\b\w*(?:error|exception|timeout|failure|traceback)\b|\b(?:failed|timed out|aborted|refused|unavailable|crashed|rejected)\b", re.I)
_CURED = re.compile(r"\b(?:succeeded|recovered|success(?:ful(?:ly)?)?|resolved|worked|ok after|fixed)\b|^\s*(?:warning|note|info|notice|debug)\b", re.I)
_NOTHING = re.compile(
    r"^(?:n\.?/?a\.?|none|null|nil|nan|undefined|empty|blank|tbd|todo|\(?no answer\)?|\W*)$",
    re.I,
)

# Refusal grammar: opening? subject refusing-verb (act ...)?, or one of the set phrases.
_OPEN = r"(?:(?:i'?m |i am |we'?re |we are )?(?:so |very |really )?(?:sorry|regrettabl[ey]|unfortunately|(?:my |i )?apolog\w+|i regret)(?: to say)?[,:;.! -]*(?:but |that )?)*"
_SUBJECT = r"(?:i|we|this (?:assistant|model|system)|the (?:assistant|model|system)|as an? [\w -]{2,30}(?:assistant|model|ai|system),? (?:i|we)|my (?:rules|guidelines|policy|policies))"
_ABLE = r"(?: (?:be )?(?:able|allowed|permitted|willing|comfortable|going|want|wish|in a position|have (?:the )?(?:permission|right)))?"
_UNWILLING = (
    rf"(?:(?:ca|could|wo|would|may|must|should|sha|do|did|are|is)n'?t\b{_ABLE}|(?:can|could|will|would|may|must|should|shall|do|did|am|'m|are|is) not\b{_ABLE}|cannot\b{_ABLE}"
    r"|(?:would|'d) (?:prefer|rather) not\b|prefer not\b|(?:must |have to |will |do )?(?:declin|refus)(?:e|es|ed)\b|(?:am|are|is|'m) unable\b|have no (?:view|opinion|comment)\b)"
)
_ACT = r"(?:answer|comment|help|assist|discuss|judge|settle|speak|weigh in|go into|give|provide|take a side|share|say|respond|reply|talk|speculate|fulfil|fulfill|comply|do that|offer|engage|disclose|analy[sz]e|address|continue|tell|reveal|name|support)"
_REFUSALS = [
    re.compile(rf"^{_OPEN}{_SUBJECT},? ?{_UNWILLING}(?: in good conscience)?(?: to)?(?: be able to| \w+ly)?[ ,]*(?:{_ACT}\b|on\b|with\b|$|[.!])", re.I),
    re.compile(rf"^{_OPEN}{_SUBJECT},? ?(?:have no (?:view|opinion|comment)|(?:must |have to |will |do )?(?:declin|refus)(?:e|ed|es)|(?:am|'m|are|is) (?:unable|not (?:able|allowed|permitted|comfortable|willing)))\b", re.I),
    re.compile(rf"^{_OPEN}{_SUBJECT} (?:(?:have|has|need|needs|must|will|would like) (?:to )?)?(?:pass|skip|abstain|refrain)\b", re.I),
    re.compile(rf"^{_OPEN}(?:my|our|the) (?:\w+ )?(?:rules|guidelines|polic(?:y|ies)|instructions|training)\b.{{0,12}}\b(?:not|n't|forbids?|prohibits?|prevents?|bars?|rules? out|stops?)\b", re.I),
    re.compile(rf"^{_OPEN}(?:unable|not able|not allowed|not permitted) to {_ACT}\b", re.I),
    re.compile(rf"^{_OPEN}no (?:answer|comment|reply|response)\b.{{0,20}}\b(?:can|could|will|may|from|is|at this)\b", re.I),
    re.compile(rf"^{_OPEN}(?:this|the|such an?|your|that) (?:request|question|query|topic)\b.{{0,25}}\b(?:cannot|can'?t|can not|may not|must not|will not|won'?t|is (?:outside|beyond|against|not))\b", re.I),
    re.compile(rf"^{_OPEN}(?:that|this|it) (?:is|would be|falls|goes|lies|'s) (?:outside|beyond|against|not (?:something|appropriate|possible for me))\b", re.I),
    re.compile(rf"^{_OPEN}it (?:would|is|isn'?t|wouldn'?t|'s) (?:not )?(?:be )?(?:not )?(?:appropriate|proper|right|possible|ethical|allowed)\b.{{0,40}}\b(?:me|us|answer|reply|comment|respond)\b", re.I),
    re.compile(rf"^{_OPEN}(?:that|this|it)(?: is|'s) (?:a |an |something |some )?(?:question|matter|topic|subject|thing|one)?\b.{{0,60}}\bnot (?:one )?(?:for me|mine|me|up to me|for this (?:assistant|model))\b", re.I),
    re.compile(r"^answering (?:this|that)?\s?.{0,20}would (?:break|violate)\b", re.I),
    re.compile(r"^(?:(?:leider|es tut mir leid|tut mir leid|entschuldigung|bedaure|sorry)[,:.! -]*(?:aber )?)*(?:(?:das |dazu |darauf |hierzu )?(?:kann|darf|möchte|werde|will) (?:ich|wir)\b.*\b(?:nicht|keine?n?)\b|(?:ich|wir|dieses? \w+) (?:kann|können|darf|dürfen|möchte|möchten|werde|werden|will|wollen|lehne|verweigere|muss)\b.*\b(?:nicht|keine?n?|ab|ablehnen|verweigern)\b)", re.I),
    re.compile(r"^(?:(?:désolée?|je suis désolée?|pardon|malheureusement|je regrette)[,:.! -]*(?:mais )?)*(?:je|nous|ce modèle|cet assistant)\b (?:ne |n')(?:peux|puis|pouvons|peut|veux|souhaite|dois|suis|saurais)\b.*", re.I),
    re.compile(r"^(?:(?:lo siento|lo lamento|perdón|lamentablemente|disculpe)[,:.! -]*(?:pero )?)*(?:(?:yo |este \w+ )?no (?:puedo|podemos|puede|debo|debemos|debe|quiero|deseo|me es posible|estoy autorizad[oa])\b|(?:me |nos )?(?:niego|negamos|abstengo)\b).*", re.I),
]
_LACK = re.compile(r"^\W*insufficient (?:information|data|context|evidence)\W*$", re.I)

_SCRIPTS = [("cyrillic", 0x400, 0x52F), ("greek", 0x370, 0x3FF), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x6FF), ("devanagari", 0x900, 0x97F), ("thai", 0xE00, 0xE7F), ("kana", 0x3040, 0x30FF), ("han", 0x4E00, 0x9FFF), ("hangul", 0xAC00, 0xD7AF)]


def script_of(text: str) -> str:
    """The script of most letters."""
    counts: dict[str, int] = {}
    for ch in text:
        if ch.isalpha():
            o = ord(ch)
            name = "latin" if o < 0x250 else next((n for n, a, b in _SCRIPTS if a <= o <= b), "latin")
            counts[name] = counts.get(name, 0) + 1
    return max(counts, key=lambda n: (counts[n], n)) if counts else "latin"


def copies(query: str, answer: str, answer_share: float = 0.8, query_share: float = 0.5) -> bool:
    """Tiles of two words or more cover the answer and a good part of the query."""
    q, a = words_of(query), words_of(answer)
    # Tiles do not overlap in the query, so they cannot cover more words of an answer than the query has.
    if len(q) < 4 or len(a) < 4 or len(a) < len(q) * query_share or len(a) * answer_share > len(q):
        return False
    codes: dict[str, int] = {}
    arrays = [np.array([codes.setdefault(w, len(codes) + 1) for w in ws], np.uint64) for ws in (a, q)]
    covered = sum(k for _, _, k in greedy_tiles(arrays[0], arrays[1], 2))
    return covered >= answer_share * len(a) and covered >= query_share * len(q)


# Words that cannot end an answer.
_DANGLING = set("the a an of and or that which who to in for with near over during between by from at on against into le la les de du des un une et entre der die das ein eine und zwischen el los las una y con por para".split())
_TAIL = re.compile(r"^[\s.!?\"'”’»)]*$|^[\s.\"'”’]*\((?:see|siehe|voir|véase)\b")
_LABELS = {"yes", "no", "before", "after"}
_WHOLE = {"yes", "no", "before", "after", "ja", "nein", "oui", "non", "sí", "si"}


def cut_reasoning(reasoning: str | None) -> bool:
    """The reasoning stops before its sentence does, or with something open, wherever it was opened."""
    text = (reasoning or "").strip()
    if not text:
        return False
    if re.search(r"(?:\.{3,}|…|\[\+?\d+ \w+\])$", text[-80:]) or broken_end(text):  # a sign for lost text has at most 80 characters
        return True
    if text.rstrip("\"'”’»)]*_`>")[-1:] not in tuple(".!?。！？") and not text.endswith(("\n```", "\n~~~")):
        return True
    return list_mark_end(text) or bool(open_elements(text))


def cut_answer(answer: str, reasoning: str | None, limit: int) -> bool:
    """The answer stops before the phrase does that it begins."""
    raw = answer.strip()
    text = raw.strip("\"'“”‘’` ").rstrip()
    bare = text.rstrip(".!?")
    if not bare or bare.lower() in _WHOLE:
        return False
    if re.search(r"(?:\.{3}|…)$", text[-3:]) or broken_end(text) or list_mark_end(raw) or open_elements(raw):
        return True
    low, why = bare.lower(), (reasoning or "").lower()
    at = why.rfind(low)
    if at >= 0:
        rest = why[at + len(low) :]
        if _TAIL.match(rest) and not cut_reasoning(reasoning):
            return False  # the conclusion in full
        if at == 0 or not why[at - 1].isalnum():
            if rest[:1].isalnum():
                return True
            # The last sentence is the conclusion if the answer stands near its start; it goes on where the answer ends.
            start = max((m.end() for m in re.finditer(r"[.!?]\s", why[max(0, at - 200) : at])), default=0) + max(0, at - 200)
            end = re.search(r"[.!?](?:\s|$)", rest)
            if end and not rest[end.end() :].strip() and len(low) > 3 and re.match(r"\s\w", rest) and len(why[start:at].split()) <= 5:
                return True
    if len(raw) >= limit and raw[-1:] not in tuple(".!?\"”"):
        return True
    last = words_of(bare)[-1:]
    return bool(last) and last[0] in _DANGLING and " " in bare


def defect(query: str | None, answer: str | None, reasoning: str | None, error: str | None, kind: str | None, limit: int = 70, profiles: Profiles | None = None) -> str | None:
    """The kind of defect of one pair, or None."""
    a = (answer or "").replace("\u200b", "").replace("\ufeff", "").strip()
    r = (reasoning or "").strip()
    note = (error or "").strip()
    if note and _ERROR.search(note) and not _CURED.search(note):
        return "failed"
    if PLACEHOLDER.match(a) or (PLACEHOLDER.match(r) and (not a or _NOTHING.match(a.strip("\"'` ")))):
        return "failed"
    if not a or _NOTHING.match(a.strip("\"'`“”[]{}() ")):
        return "empty"
    q = (query or "").strip()
    if q and copies(q, a):
        return "copied_question"
    straight = a.replace("’", "'").replace("‘", "'").strip("\"“” ")
    if any(p.search(straight) for p in _REFUSALS) or (_LACK.match(a) and kind != "null_query"):
        return "refusal"
    if q:
        if script_of(q) not in (script_of(a), "") and any(ch.isalpha() for ch in a):
            return "other_language"
        if any(ch.isalpha() for ch in r) and script_of(r) != script_of(q) and not PLACEHOLDER.match(r):
            return "other_language"
        asked = profiles.language(q) if profiles else None
        if asked and asked != "other":
            # A label such as "Insufficient information" or "Yes" is a fixed value of the task.
            if profiles.differs(asked, a) and not (_LACK.match(a) or a.strip(" .\"'").lower() in _LABELS):
                return "other_language"
            if profiles.differs(asked, r) and not PLACEHOLDER.match(r):
                return "other_language"
    if cut_reasoning(r) and not PLACEHOLDER.match(r):
        return "truncated"
    if cut_answer(a, r, limit):
        return "truncated"
    return None


def find_defects(
    pairs: DataFrame,
    key: str = "result_id",
    query: str = "query",
    answer: str = "final_answer",
    reasoning: str = "reasoning",
    error: str = "inference_error",
    kind: str = "question_type",
    limit: int = 70,
    profiles: Profiles | None = None,
) -> DataFrame:
    """One row per distinct id: record_id and defect (null for a sound pair)."""
    fields = [query, answer, reasoning, error, kind]
    once = pairs.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("record_id")).agg(F.min(F.struct(*[F.col(c).cast("string").alias(f"f{i}") for i, c in enumerate(fields)])).alias("r"))
    once = once.select("record_id", *[F.col(f"r.f{i}").alias(f"f{i}") for i in range(len(fields))])

    shared = pairs.sparkSession.sparkContext.broadcast(profiles)  # bounded by the profiles' sample

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [defect(*row, limit=limit, profiles=shared.value) for row in zip(*[batch.column(i).to_pylist() for i in range(1, 6)])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["record_id", "defect"])

    return once.mapInArrow(look, f"record_id {pairs.schema[key].dataType.simpleString()}, defect string")
