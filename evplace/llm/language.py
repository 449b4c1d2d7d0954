"""The language of short texts, by profiles of words and character trigrams.

Profiles are fitted on a bounded sample of labelled texts: ``per_language`` texts of each of the
``languages`` most frequent labels, those with the least hash of their id. Any language that the
corpus labels can be told. For four of them the closed classes of words (articles, pronouns,
prepositions, conjunctions, auxiliaries, negations, small numbers) are added to the profile, as a
sample seldom holds all of them; no word of the content of texts is built in.

Only plain words count: names (capitalised words and the particles between them) belong to no
language. A sentence's first word counts if it is known in lower case. A word scores by its own
frequency and by its trigrams, smoothed; the scores are logarithms, so differences are evidence.
A text of five words or more, hardly any of them known, that fits no profile (below ``floor`` a
trigram, where the fitted texts are far above it) is of a language without a profile.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

_TOKEN = re.compile(r"[^\W\d_]+")
_FIRST = re.compile(r"(^|[.!?:¿¡]\s*|\n)([^\W\d_]+)")
_NAMES = re.compile(r"\b[^\W\d_a-zß-öø-ÿ][\w'’-]*(?:(?: (?:de la|de|du|des|del|la|le|los|las|von|van|der|of|the|and|&))? [^\W\d_a-zß-öø-ÿ][\w'’-]*)*")


# Words of the closed classes.
CLOSED = {
    "en": "a an the this that these those i you he she it we they me him her us them my your his its our their who whom whose which what and or but nor if because although while"
    " of in on at by for with about against between into through during before after above below to from up down out off over under is are was were be been being am has have had"
    " do does did will would shall should can could may might must not no than as so when where why how one two three four five both each few more most other some such",
    "de": "der die das den dem des ein eine einen einem einer eines ich du er sie es wir ihr mich dich ihn uns euch ihnen mein dein sein unser dieser diese dieses jener welche welcher"
    " und oder aber denn sondern weil dass ob wenn obwohl während in im an am auf aus bei mit nach seit von vom zu zum zur durch für gegen ohne um über unter vor zwischen neben"
    " ist sind war waren sei bin hat haben hatte hatten wird werden wurde wurden kann können muss müssen soll sollen will nicht kein keine nein ja als wie so wo warum wann ein zwei drei vier fünf beide etwas nichts",
    "fr": "le la les l un une des du de je tu il elle nous vous ils elles me te se lui leur leurs mon ton son notre votre ce cet cette ces qui que quoi dont où quel quelle"
    " et ou mais ni car si parce puisque lorsque dans en sur sous à au aux par pour avec sans chez vers entre avant après depuis pendant contre est sont était étaient être suis"
    " a ont avait avaient avoir sera seront peut peuvent doit ne pas non oui plus moins comme quand pourquoi comment deux trois quatre cinq autre autres même rien tout tous",
    "es": "el la los las un una unos unas del al de yo tú él ella nosotros ellos ellas me te se le les lo mi tu su sus nuestro este esta estos estas ese esa aquel que quien cual cuyo donde"
    " y e o u pero ni si porque aunque mientras en con por para sin sobre entre desde hasta hacia contra según ante tras durante es son era eran fue fueron ser estar está están"
    " ha han había habían haber será puede pueden debe no sí más menos como cuando dos tres cuatro cinco otro otra otros otras mismo nada todo todos ya muy",
}
CLOSED_COUNT = 20  # occurrences that a closed-class word has in its profile at least


def grams(word: str) -> list[str]:
    padded = f"^{word}$"
    return [padded[i : i + 3] for i in range(len(padded) - 2)]


class Profiles:
    """Word and trigram frequencies per language."""

    def __init__(self, texts: Iterable[tuple[str, str]], floor_share: float = 0.02) -> None:
        words: dict[str, Counter[str]] = {}
        parts: dict[str, Counter[str]] = {}
        capital: Counter[str] = Counter()
        kept = [(lang, t) for lang, t in texts if t]
        for lang, t in kept:
            plain = _TOKEN.findall(_NAMES.sub(" ", t))
            words.setdefault(lang, Counter()).update(plain)
            parts.setdefault(lang, Counter()).update(g for w in plain for g in grams(w))
            capital.update(w.lower() for w in _TOKEN.findall(t) if w[0].isupper())
        for lang in set(words) & set(CLOSED):
            for w in set(CLOSED[lang].split()):
                more = max(0, CLOSED_COUNT - words[lang][w])
                words[lang][w] += more
                parts[lang].update({g: more for g in grams(w)})
        self.languages = sorted(words)
        small = sum(words.values(), Counter())
        self.known = {w for w, n in small.items() if n > 1 and n >= capital[w]}
        self.names = {w for w, n in capital.items() if n > 1 and n > small[w]}
        self.word_logs = self._logs(words)
        self.gram_logs = self._logs(parts)
        none = [0.5 / (sum(parts[x].values()) + 0.5 * (len(self.gram_logs) + 1)) for x in self.languages]
        self.no_gram = [math.log(x) for x in none]
        # The floor: what hardly any fitted sentence falls below, and as much again.
        fits = sorted(self.fit(w) for w in (self.plain(s) for _, t in kept for s in re.split(r"(?<=[.!?])\s", t)[:6]) if len(w) >= 5)
        self.floor = self.middle = -math.inf
        if fits:
            low, middle = fits[int(len(fits) * floor_share)], fits[len(fits) // 2]
            self.floor, self.middle = low - 2 * (middle - low), middle

    def _logs(self, counts: dict[str, Counter[str]]) -> dict[str, list[float]]:
        every = set().union(*counts.values()) if counts else set()
        total = [sum(counts[x].values()) + 0.5 * (len(every) + 1) for x in self.languages]
        return {k: [math.log((counts[x][k] + 0.5) / n) for x, n in zip(self.languages, total)] for k in every}

    def plain(self, text: str) -> list[str]:
        """The words of a text in lower case; names, also those written small, set aside."""
        if text.isupper():
            text = text.lower()
        # A lone capitalised word is a name, also at the start.
        if any(w[0].islower() for w in _TOKEN.findall(_NAMES.sub(" ", text))):
            text = _FIRST.sub(lambda m: m[1] + (m[2].lower() if m[2].lower() in self.known else m[2]), text)
        return [w for w in (x.lower() for x in _TOKEN.findall(_NAMES.sub(" ", text))) if w not in self.names]

    def scores(self, words: list[str]) -> tuple[list[float], list[float]]:
        """Logarithm of the likelihood in every language: of the words that any language knows, and of those and all trigrams."""
        each = range(len(self.languages))
        told = [self.word_logs[w] for w in words if w in self.word_logs]
        parts = [self.gram_logs.get(g, self.no_gram) for w in words for g in grams(w)]
        known = [sum(x[i] for x in told) for i in each]
        return known, [known[i] + sum(x[i] for x in parts) / 3 for i in each]

    def fit(self, words: list[str]) -> float:
        """Mean logarithm a trigram under the language that fits best."""
        parts = [self.gram_logs.get(g, self.no_gram) for w in words for g in grams(w)]
        return max((sum(x[i] for x in parts) / len(parts) for i in range(len(self.languages))), default=0.0) if parts else 0.0

    def strange(self, words: list[str]) -> bool:
        """Several words, hardly any of them known, that fit no profile."""
        return len(words) >= 5 and 4 * sum(w in self.word_logs for w in words) <= len(words) and self.fit(words) < self.floor

    def language(self, text: str | None, margin: float = 3.0) -> str | None:
        """The language that is likelier than any other by ``margin``, None without such evidence, "other" below the floor."""
        words = self.plain(text) if text else []
        if not words or not self.languages:
            return None
        if self.strange(words):
            return "other"
        ranked = sorted(zip(self.scores(words)[1], self.languages), reverse=True)
        return ranked[0][1] if len(ranked) == 1 or ranked[0][0] - ranked[1][0] >= margin else None

    def differs(self, asked: str, text: str | None, margin: float = 3.0) -> bool:
        """Another language than ``asked`` is likelier by ``margin``, also by the known words alone, or no profile fits."""
        words = self.plain(text) if text else []
        if not words or asked not in self.languages:
            return False
        if self.strange(words):
            return True
        at = self.languages.index(asked)
        known, every = self.scores(words)
        best = max(range(len(every)), key=lambda i: every[i])
        # Words that none knows may be names written small: without a known word only a text that fits well says something.
        sure = known[best] > known[at] or (not any(known) and self.fit(words) >= self.middle and every[best] - every[at] >= 2 * margin)
        return every[best] - every[at] >= margin and sure


def train_profiles(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 200, languages: int = 40) -> Profiles:
    """Profiles of at most ``languages`` languages, each from at most ``per_language`` texts (labels as ``EN`` or ``en-GB`` count as ``en``)."""
    label = F.lower(F.regexp_extract(F.col(lang), r"^\s*([A-Za-z]{2,3})(?:[-_].*)?\s*$", 1))
    labelled = docs.select(F.col(doc_id).alias("id"), label.alias("label")).where("label <> ''").withColumn("h", F.xxhash64("id"))
    most = [r[0] for r in labelled.groupBy("label").count().orderBy(F.desc("count"), "label").limit(languages).collect()]
    first = W.Window.partitionBy("label").orderBy("h", "id")
    chosen = labelled.where(F.col("label").isin(most)).withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= per_language)
    ids = {r[0]: r[1] for r in chosen.select("id", "label").collect()}  # per_language x languages rows at most
    rows = docs.where(F.col(doc_id).isin(list(ids))).select(F.col(doc_id), F.col(text)).dropDuplicates([doc_id]).collect() if ids else []
    return Profiles(sorted((ids[r[0]], r[1] or "") for r in rows))
