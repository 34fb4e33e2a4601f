"""Problem 10: the language of documents and of the paragraphs of mixed ones, by rank-order profiles.

A profile is the ranking of the most frequent n-grams (one to five letters, within padded words) of a language; a text
goes to the language whose ranking is the least out of place. Profiles start from the short texts below and are then
refitted on a bounded sample of labelled documents (``sample_per_language``, a parameter), of which only those count
whose label the first profiles confirm, so wrong labels don't enter. Everything else covers all documents alike.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Starting texts of the languages.
STARTING_TEXTS = {
    "en": "The children were waiting for the bus when it began to rain, and nobody had brought an umbrella. After a while the driver came back with the keys and told them that they would have to walk to the next stop. This is one of those days which people remember for a long time, because everything that could go wrong did. At the end of the week the office lists which of the orders have been checked and what is still missing from each page.",
    "de": "Die Kinder warteten auf den Bus, als es zu regnen begann, und niemand hatte einen Schirm dabei. Nach einer Weile kam der Fahrer mit den Schlüsseln zurück und sagte ihnen, dass sie bis zur nächsten Haltestelle gehen müssten. Das ist einer von den Tagen, an die man sich lange erinnert, weil alles schiefging, was schiefgehen konnte. Am Ende der Woche zeigt das Büro, welche Bestellungen geprüft wurden und was auf jeder Seite noch fehlt.",
    "fr": "Les enfants attendaient le bus quand il a commencé à pleuvoir, et personne n'avait apporté de parapluie. Après un moment, le chauffeur est revenu avec les clés et leur a dit qu'ils devraient marcher jusqu'au prochain arrêt. C'est une de ces journées dont on se souvient longtemps, parce que tout ce qui pouvait aller mal est allé mal. À la fin de la semaine, le bureau montre quelles commandes ont été vérifiées et ce qui manque encore dans chaque page.",
    "es": "Los niños esperaban el autobús cuando empezó a llover, y nadie había traído un paraguas. Después de un rato el conductor volvió con las llaves y les dijo que tendrían que caminar hasta la próxima parada. Este es uno de esos días que la gente recuerda durante mucho tiempo, porque todo lo que podía salir mal salió mal. Al final de la semana la oficina muestra qué pedidos se han comprobado y lo que todavía falta en cada página.",
    "pt": "As crianças esperavam o autocarro quando começou a chover, e ninguém tinha trazido um guarda-chuva. Depois de algum tempo o motorista voltou com as chaves e disse-lhes que teriam de caminhar até à próxima paragem. Este é um daqueles dias que as pessoas não esquecem, porque tudo o que podia correr mal correu mal. No fim da semana o escritório mostra quais os pedidos que foram verificados e o que ainda falta em cada página, com as informações da reunião.",
    "it": "I bambini aspettavano l'autobus quando ha cominciato a piovere, e nessuno aveva portato un ombrello. Dopo un po' l'autista è tornato con le chiavi e ha detto loro che avrebbero dovuto camminare fino alla prossima fermata. Questo è uno di quei giorni che la gente ricorda a lungo, perché tutto quello che poteva andare male è andato male. Alla fine della settimana l'ufficio mostra quali ordini sono stati controllati e che cosa manca ancora in ogni pagina.",
    "ja": "子供たちがバスを待っていると雨が降り始めましたが、誰も傘を持っていませんでした。しばらくして運転手が鍵を持って戻り、次の停留所まで歩かなければならないと言いました。これは人々が長い間覚えている日の一つです。週の終わりに事務所は、どの注文を確認したか、それぞれのページに何が足りないかを示しています。",
}
#: Labels that say nothing.
NO_LABEL = ("", "und", "unknown")

_RUN = re.compile(r"[^\W\d_]+")
_FENCE = re.compile(r"^[ \t]*(```|~~~).*?(?:^[ \t]*\1[ \t]*$|\Z)", re.M | re.S)
_CODE_LINE = re.compile(r"`[^`\n]*`|https?://\S+|\S+@\S+")
_BLANK = re.compile(r"\n[ \t\r]*(?:\n[ \t\r]*)+")


def paragraphs(text: str) -> list[str]:
    """The blocks between blank lines, in their order."""
    return [p for p in _BLANK.split(text.strip("\n\r")) if p.strip()]


def running_text(paragraph: str) -> str:
    """What is left of a paragraph without code, JSON, addresses and links; empty if it isn't running text."""
    t = _FENCE.sub(" ", paragraph) if "```" in paragraph or "~~~" in paragraph else paragraph
    s = t.strip()
    if s[:1] in "{[" and s[-1:] in "}]" and '"' in s:
        return ""
    return _CODE_LINE.sub(" ", t) if "`" in t or "@" in t or "://" in t else t


def _grams(word: str) -> list[str]:
    w = f"_{word}_"
    return [w[i : i + n] for n in range(1, 6) for i in range(len(w) - n + 1) if w[i : i + n] != "_"]


class Profiles:
    """Rankings of the languages; picklable, and the same result for the same text in every process."""

    def __init__(self, texts: dict[str, list[str]], size: int = 400):
        self.langs = sorted(texts)
        self.size = size
        ranks: dict[str, dict[str, int]] = {}
        for lang in self.langs:
            c: Counter[str] = Counter()
            words: Counter[str] = Counter()
            for t in texts[lang]:
                words.update(w.casefold() for w in _RUN.findall(t))
            for w, n in words.items():
                for g in _grams(w):
                    c[g] += n
            best = sorted(c.items(), key=lambda x: (-x[1], x[0]))[:size]
            ranks[lang] = {g: i for i, (g, _) in enumerate(best)}
        self.number = {g: i for i, g in enumerate(sorted({g for r in ranks.values() for g in r}))}
        self.rank = np.full((len(self.langs), len(self.number)), size, np.int32)
        for a, lang in enumerate(self.langs):
            for g, i in ranks[lang].items():
                self.rank[a, self.number[g]] = i
        self._places = np.arange(size, dtype=np.int32)
        self._cache: dict[str, np.ndarray] = {}

    def __getstate__(self):
        return self.__dict__ | {"_cache": {}}

    def _of_word(self, word: str) -> np.ndarray:
        if len(self._cache) > 200_000:
            self._cache.clear()
        got = self._cache[word] = np.array([self.number[g] for g in _grams(word.casefold()) if g in self.number], np.int64)
        return got

    def distances(self, words: list[str]) -> np.ndarray | None:
        """Mean out-of-place distance to each language, 0 to 1; None if the words have no n-gram of any profile."""
        if not words:
            return None
        get, make = self._cache.get, self._of_word
        count = np.bincount(np.concatenate([x if (x := get(w)) is not None else make(w) for w in words]), minlength=1)
        ids = count.nonzero()[0]
        n = len(ids)
        if not n:
            return None
        # one sort by falling count, then number; numbers are below their count, so the two don't mix
        order = ids[(ids - count[ids] * len(self.number)).argsort()[: self.size]]
        return np.abs(self.rank[:, order] - self._places[: len(order)]).sum(axis=1) / (len(order) * self.size)

    def best(self, words: list[str]) -> tuple[str, float, list[float]] | None:
        """Language, confidence (lead over the next language, 0 to 1) and all distances."""
        got = self.distances(words)
        if got is None:
            return None
        d = got.tolist()
        first, second = sorted(range(len(d)), key=d.__getitem__)[:2]
        return self.langs[first], (d[second] - d[first]) / max(d[second], 1e-9), d


def plain_label(label):
    """The label in lower case without blanks and region suffix; null where it says nothing."""
    s = F.regexp_replace(F.lower(F.trim(label)), r"[-_].*$", "")
    return F.when(s.isin(*NO_LABEL), None).otherwise(s)


def fit_profiles(documents: DataFrame, sample_per_language: int = 300, size: int = 400) -> Profiles:
    """Profiles fitted on at most ``sample_per_language`` labelled documents of each language, chosen by a hash of the id.

    The sample is of texts of 200 to 20,000 characters, so what the driver gets has a bound.
    """
    start = Profiles({k: [v] for k, v in STARTING_TEXTS.items()}, size)
    texts = {k: [v] for k, v in STARTING_TEXTS.items()}
    labelled = documents.select(F.xxhash64("doc_id").alias("h"), plain_label(F.col("lang")).alias("lang"), "text").filter(
        F.col("lang").isin(*start.langs) & F.col("text").isNotNull()
    )
    # the smallest hash of each language and slot: at most sample_per_language ids of each, on narrow rows; only their
    # texts are fetched
    slot = F.pmod("h", F.lit(sample_per_language))
    chosen = labelled.filter("char_length(text) between 200 and 20000").select("lang", slot.alias("slot"), "h").groupBy("lang", "slot").agg(F.min("h").alias("h"))
    rows = labelled.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "slot").agg(F.first("text").alias("text")).collect()
    for r in sorted(rows, key=lambda r: (r.lang, r.slot)):
        t = running_text(r.text)
        got = start.best(_RUN.findall(t))
        if got and got[0] == r.lang and len(t) >= 200:
            texts[r.lang].append(t)
    return Profiles(texts, size)


#: What no profile fits.
UNKNOWN = "und"
_KANA = re.compile("[\u3041-\u30ff]")


def recognised(profiles: Profiles, words: list[str], far: float = 0.33, lead: float = 0.06) -> tuple[str, float, list[float] | None]:
    """Language, confidence and distances of some words; ``UNKNOWN`` if no profile has an n-gram of them, or if the nearest
    is ``far`` and hardly nearer than the next, or if it is Japanese without a kana."""
    got = profiles.best(words)
    if got is None:
        return UNKNOWN, 0.0, None
    lang, conf, d = got
    if conf < lead and min(d) >= far or lang == "ja" and not _KANA.search("".join(words)):
        return UNKNOWN, 0.0, d
    return lang, conf, d


def judge(profiles: Profiles, text: str, sure: float = 0.05, doubt: float = 20) -> tuple[str, float, list[tuple[int, str, float]]] | None:
    """Main language with confidence, and (number, language, confidence) of each paragraph of running text.

    A paragraph counts as written in another language than the rest if its lead over the main language, discounted by
    ``doubt`` letters that say nothing, is ``sure`` or more; else it has the main language. None if there is no running text.
    """
    found = []
    for no, p in enumerate(paragraphs(text), 1):
        t = running_text(p)
        words = _RUN.findall(t)
        if words:
            found.append((no, len(t.strip()), sum(map(len, words)), recognised(profiles, words)))
    if not found:
        return None
    chars: Counter[str] = Counter()
    for _, n, _, (lang, _, _) in found:
        chars[lang] += n
    if len(chars) > 1:
        del chars[UNKNOWN]
    main = min(chars, key=lambda x: (-chars[x], x))
    out, weight, total = [], 0.0, 0
    for no, n, letters, (lang, conf, d) in found:
        if lang != main and d is not None and main != UNKNOWN:
            at = d[profiles.langs.index(main)]
            if (at - min(d)) / max(at, 1e-9) * letters / (letters + doubt) < sure:
                lang, conf = main, 0.0
        out.append((no, lang, conf))
        weight, total = weight + conf * n * (lang == main), total + n
    return main, weight / max(total, 1), out


def document_languages(documents: DataFrame, sample_per_language: int = 300) -> DataFrame:
    """``doc_id, para_no, lang, confidence, label``: para_no 0 with the main language of every document with running
    text, and one row per paragraph of each document whose paragraphs are in more than one language.

    Null ids and texts and texts of code or JSON only give no row; repeated ids count once; extra columns are ignored.
    Paragraphs without running text keep their number but have no row. What no profile fits is ``und``.
    """
    profiles = fit_profiles(documents, sample_per_language)
    handed = documents.sparkSession.sparkContext.broadcast(profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = handed.value
        for b in batches:
            rows: list[tuple] = []
            for doc_id, text, label in zip(*(c.to_pylist() for c in b.columns)):
                got = judge(model, text)
                if got is None:
                    continue
                main, conf, parts = got
                rows.append((doc_id, 0, main, conf, label))
                if len({x for _, x, _ in parts}) > 1:
                    rows.extend((doc_id, no, lang, c, label) for no, lang, c in parts)
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.string()))],
                names=["doc_id", "para_no", "lang", "confidence", "label"],
            )

    docs = documents.select("doc_id", "text", plain_label(F.col("lang")).alias("label")).filter("doc_id is not null and text is not null")
    return docs.mapInArrow(run, "doc_id bigint, para_no int, lang string, confidence double, label string").dropDuplicates(["doc_id", "para_no"])


def wrong_labels(languages: DataFrame) -> DataFrame:
    """Of ``document_languages``: main languages that the label lacks or contradicts, and all rows of mixed paragraphs.

    What no profile fits contradicts no label.
    """
    wrong = (F.col("para_no") > 0) | F.col("label").isNull() | (F.col("label") != F.col("lang"))
    return languages.filter(wrong & (F.col("lang") != UNKNOWN)).select("doc_id", "para_no", "lang", "confidence")
