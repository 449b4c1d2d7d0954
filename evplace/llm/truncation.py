"""Texts cut off by field limits or in transfer, and how often each source cuts.

A pushdown parser and the end of the text decide, per document:

* ``marker``  a sign stands for lost text (``…``, ``[...]``, ``[+623 chars]``) and what
  is left before it does not end a sentence;
* ``broken``  the end lies inside a character, an escape, an entity or a tag;
* ``open``    the stack is not empty at the end: a fence or an element, a quote or bracket
  of the last sentence, or a list item of which only the sign is there;
* ``bare``    the last line neither ends a sentence nor is a sign-off, tag line, link
  or informal closing.

A bare end is a cut unless it is a closing that is learned, or it could be whole, the source has the custom of omitting
stops and no limit shows:

* a closing is learned: a last line of its own, not ending in a comma, dash or word that must go on, that ends at least
  three texts and the share ``closing_share`` of all, after different lines (a copied text repeats the line before it as
  well, so copies of one cut text teach nothing);
* an end could be whole if the text itself does without stops there: the last line holds no sentence that ended before,
  the other lines do not end in stops as a rule, and the end is no comma, dash or word that must go on. An end inside a
  sentence, a clause or a word of a text with stops is a cut whatever its source does;
* a source has the custom if the share of its texts whose ends could be whole is ``baseline`` or more, at the lower end
  of the 95 % interval, so few texts show no custom and no count is fixed;
* a limit shows where at least ``limit_share`` of the source's ends that could be whole pile up within ``spread`` below a
  length (limits in bytes or words spread), four times as dense as the lengths around and beyond chance.

Closings, customs and limits are computed over all documents; only their keys are joined back. Not told: a stopless
line cut inside a word, in a source of such lines, away from any limit.

Bounds of the grammar: a sign for lost text has at most 200 characters, a dash line 60, a by-line six names.

Defined results: null and blank texts are whole; a null source is a source of its own;
repeated rows are each judged; texts are read whole, whatever their length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..operators.metrics import wilson
from ..session import materialise
from .pairs import _DANGLING
from .structure import broken_end, left_open, list_mark_end, terminated

_MARKER = re.compile(r"\s*(?:[\[(<{]\s*(?:\.{2,}|…|\+?\s?\d[\d,. ]*\s*(?:more )?(?:chars?|characters|words|bytes|lines|more)[^\])>}]{0,20}|(?:text |message |article )?(?:truncated|cut|snip(?:ped)?|more|continued|read more)[^\])>}]{0,20})\s*[\])>}]|…|\.{3,})\s*$", re.I)
# Informal closings that may end in an ellipsis or without a stop.
_CLOSING = re.compile(
    r"^(?:\w+: )?(?:(?:well|so|ok|okay|oh|hm+|anyway|ach|na ja|bueno|bon|eh bien)[,.]? )?"
    r"(?:we(?:'| wi)ll see|i(?:'| wi)ll think about it|let'?s see|let me think|time will tell|who knows|to be continued|and so on|etc|talk soon|see you(?: soon| later)?"
    r"|mal sehen|wir werden sehen|und so weiter|usw|bis bald|on verra(?: bien)?|et ainsi de suite|à suivre|à bientôt|ya veremos|veremos|y así sucesivamente|hasta luego)"
    r"(?: \w+){0,2}\s*(?:\.{3,}|…)?$",
    re.I,
)
# Words of thanks and assent; a line made of them alone closes a chat without a stop.
_THANKS = re.compile(
    r"^(?:\w+: )?(?:(?:thanks?|thank you|thx|cheers|that helps|got it|will do|sounds good|all good|no worries|perfect|great|bye|goodbye|good night|ok|okay|yes|no|cool|nice|fine"
    r"|danke|danke dir|danke schön|alles klar|tschüss|merci|merci beaucoup|d'accord|parfait|salut|gracias|vale|perfecto|adiós"
    r"|so much|very much|a lot|again|then|for now|everyone|all|too)\b[,;!.]* ?(?:and |y |et |und )?)+$",
    re.I,
)
_NAME = r"\w[\w'’.-]*"
_SIGN_OFF = [
    re.compile(rf"^(?:By|Von|Par|Por|Text|Words|Reporting by)[: ] ?{_NAME}(?: {_NAME}){{0,5}}(?:, ?\S.{{1,50}})?$"),
    re.compile(r"^[—–-]{1,2} ?\S.{1,60}$"),
    re.compile(r"^(?:Tags?|Topics?|Keywords|Filed under|Labels|Category|Categories|Schlagwörter|Themen|Mots[- ]clés|Étiquettes|Etiquetas|Temas)\s?: ?\S.*$", re.I),
    re.compile(r"^#[\w-]+(?:[ ,]+#[\w-]+)*$"),
    re.compile(r"^(?:.{0,40}[ :])?(?:https?://|www\.)\S+$"),
    re.compile(r"^\S+@\S+\.\w+$"),
]
_ENDED = re.compile(r"(?<=[^\W\d_]{3})[.!?][\"'”’»)\]]{0,3}\s+[^\sa-z]|[。！？؟।]\s*\S")  # a sentence that ended, and the next
_HEAD_LOWER = re.compile(r"^By (?:the|a|an|this|that|its|their|then|now)\b", re.I)

def judge(text: str | None) -> tuple[str, int]:
    """(kind, length): '' for a whole text, else marker, broken, open or bare."""
    if not text or not text.strip():
        return "", 0
    length = len(text)
    body = text.rstrip()
    line = body.rsplit("\n", 1)[-1].strip()
    label = re.sub(r"^\w{2,12}: ", "", line)
    if _CLOSING.match(line) or (len(label) <= 60 and _CLOSING.match(last_clause(label))):
        return "", length
    tail = body[-200:]  # a sign for lost text is short; patterns stay off the rest, so no text takes more than linear time
    marked = _MARKER.search(tail)
    if marked:
        left = body[: len(body) - len(tail) + marked.start()].rstrip()
        return ("", length) if terminated(left) and not left.endswith("..") else ("marker", length)
    if broken_end(body):
        return "broken", length
    if terminated(body) or list_mark_end(body):
        return ("open" if left_open(body) else ""), length
    # A sign-off is a line of its own.
    if ("\n" in body or len(line.split()) <= 8) and ((any(p.match(line) for p in _SIGN_OFF) and not _HEAD_LOWER.match(line)) or _THANKS.match(line)):
        return "", length
    return ("open" if left_open(body) else "bare"), length


def closing_keys(text: str) -> tuple[str | None, str | None]:
    """The last line, without its speaker, case and outer signs, and the line before it; nulls if there is only one line."""
    head, _, line = text.rstrip().rpartition("\n")
    if not head.strip() or not may_end(line.strip()):
        return None, None
    label = re.sub(r"^\w{2,12}: ", "", line.strip()).lower().strip(" .!?…")
    return label, head.rstrip().rpartition("\n")[2][-200:]


def last_clause(line: str) -> str:
    """What follows the last full stop, question or exclamation mark before the end of the line."""
    cut = re.split(r"(?<=[.!?]) (?=\S)", line.rstrip())
    return cut[-1]


def may_end(line: str) -> bool:
    """The line ends in no comma, dash or word that must go on."""
    return (line[-1].isalnum() or line[-1] in "\"'”’»)]}*_%€$£°") and line.rsplit(None, 1)[-1].lower() not in _DANGLING


def could_be_whole(text: str) -> bool:
    """A bare end that may be the end of a line or phrase, as the text does without stops."""
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    last = lines[-1]
    if not may_end(last) or _ENDED.search(last):
        return False
    stopped = sum(terminated(x) for x in lines[:-1])
    return 2 * stopped <= len(lines) - 1


def find_truncated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", baseline: float = 0.5, limit_share: float = 0.05, spread: float = 0.03, closing_share: float = 0.001) -> DataFrame:
    """One row per document: doc_id, source, n_chars, kind and is_cut."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, lengths, phrases, closings, befores = [], [], [], [], []
            for value in batch.column(2):
                t = value.as_py()
                kind, length = judge(t)
                kinds.append(kind)
                lengths.append(length)
                phrases.append(kind == "bare" and could_be_whole(t))
                closing, before = closing_keys(t) if kind == "bare" else (None, None)
                closings.append(closing)
                befores.append(before)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(kinds, pa.string()), pa.array(lengths, pa.int64()), pa.array(phrases, pa.bool_()), pa.array(closings, pa.string()), pa.array(befores, pa.string())], ["doc_id", "source", "kind", "n_chars", "phrase", "closing", "before"])

    id_type = docs.schema[doc_id].dataType.simpleString()
    judged = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(text).alias("t")).mapInArrow(look, f"doc_id {id_type}, source string, kind string, n_chars bigint, phrase boolean, closing string, before string")
    judged = materialise(judged.withColumns({"closing": F.md5("closing"), "before": F.md5("before")}), "judged")
    learned = judged.where("closing is not null").select("closing", "before").distinct().groupBy("closing").count()
    learned = learned.where(F.col("count") >= max(3, judged.where("n_chars > 0").count() * closing_share))
    judged = judged.join(learned.select("closing", F.lit(True).alias("is_closing")), "closing", "left")
    judged = judged.withColumn("kind", F.when(F.coalesce("is_closing", F.lit(False)), "").otherwise(F.col("kind"))).withColumn("phrase", F.col("phrase") & (F.col("kind") != ""))
    custom = judged.where("n_chars > 0").groupBy("source").agg(F.count("*").alias("n"), F.count_if("phrase").alias("n_phrase")).where(wilson(F.col("n"), F.col("n_phrase"))[0] >= baseline)
    custom = custom.select(F.col("source").alias("custom_source"), "n_phrase", F.lit(True).alias("is_custom"))
    # Lengths below which the ends of such a source pile up, against the lengths around (four spreads on either side).
    at = judged.where("phrase").groupBy("source", "n_chars").agg(F.count("*").alias("k")).join(custom, F.col("source").eqNullSafe(F.col("custom_source")))
    by_length = W.Window.partitionBy("source").orderBy(F.round(F.ln("n_chars") * 1_000_000).cast("long"))
    wide = round(spread * 1_000_000)
    at = at.withColumns({"k_near": F.sum("k").over(by_length.rangeBetween(-wide, 0)), "k_around": F.sum("k").over(by_length.rangeBetween(-5 * wide, 4 * wide))})
    chance = (F.col("k_around") - F.col("k_near")) / 8
    pile = (F.col("k_near") >= F.col("n_phrase") * limit_share) & (F.col("k_near") >= 4 * chance) & (F.col("k_near") - chance >= 3 * F.sqrt(chance + 1))
    at = at.withColumn("at_limit", F.max(pile).over(by_length.rangeBetween(0, wide)))
    limits = at.where("at_limit").select(F.col("source").alias("limit_source"), F.col("n_chars").alias("limit_chars"), "at_limit")
    out = judged.join(custom, F.col("source").eqNullSafe(F.col("custom_source")), "left")
    out = out.join(limits, F.col("source").eqNullSafe(F.col("limit_source")) & (F.col("n_chars") == F.col("limit_chars")), "left")
    cut = (F.col("kind") != "") & ~(F.col("phrase") & F.coalesce("is_custom", F.lit(False)) & ~F.coalesce("at_limit", F.lit(False)))
    return out.select("doc_id", "source", "n_chars", "kind", cut.alias("is_cut"))


def source_rates(judged: DataFrame) -> DataFrame:
    """Per source: documents, cut documents, share, and the length at which most cuts fall."""
    by_length = judged.groupBy("source", "n_chars").agg(F.count("*").alias("n"), F.count_if("is_cut").alias("c"))
    return by_length.groupBy("source").agg(
        F.sum("n").alias("n_docs"),
        F.sum("c").alias("n_cut"),
        F.round(F.sum("c") / F.sum("n"), 6).alias("cut_share"),
        F.max_by(F.when(F.col("c") > 1, F.col("n_chars")), F.when(F.col("c") > 1, F.struct("c", "n_chars"))).alias("usual_limit"),
    )
