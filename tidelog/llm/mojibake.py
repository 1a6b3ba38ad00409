"""Text that was read in another encoding than it was written in: finding it, and restoring what was written.

Model. Every part of a document (its first line, its last, or those between: the *fields*) is either sound or has gone through an unknown
*chain*: bytes of one encoding read as another, once or twice. Which chain is a latent variable with a prior per source and
field. Its likelihood comes from a character model of the corpus: how much likelier the words become when the
chain is undone. Expectation-maximization takes turns between the posterior of every part and the priors of
sources and fields, which are drawn to the overall prior where a source has few pages. So evidence too weak in
one record counts where other records of its source show the same chain. A document is found if some part is more
likely garbled than not, and is repaired word by word by the chains of its posterior.

Within a line the evidence of a chain is that of its best run of words, less the price of a change (``SWITCH``): text may be garbled in part.
Numeric and named character references are read as the characters they stand for. U+FFFD within a text shows that
a decoder met bytes it couldn't read; it is a chain of its own (``lost``), whose likelihood is LOST nats a character and whose prior is learned like any other's. The original is lost then. At the very end it only shows that the text was cut.

The character model counts, for words with characters beyond ASCII, single characters, pairs and triples, hashed into
tables of fixed size, over all documents; a word counts once a document.

Scale: three narrow passes over the text (two that count, one that scores; a fourth where text is restored); what is shuffled is the model's table and a row per part and chain with evidence. The
broadcast model has a fixed size of 13 MB. Priors are tables keyed by source and field, pre-aggregated and joined by hash with a salt, so that a hot
source is spread. EM runs on evidence written to the shared folder until the priors have settled.

Nulls and odd input: null, empty and pure ASCII texts without references are sound; a null source is a source of its own; repeated doc_ids give
one row; any length is read whole; an empty table gives an empty result.
"""

from __future__ import annotations

import codecs
import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.common import HOT_KEYS, materialize, ship, spread

UNI, BI, TRI = 1 << 16, 1 << 20, 1 << 21
#: Nats: the price of a change between sound and garbled text, of a word between that the chain doesn't explain, the least gain of a word, and
#: the price of a lost character.
SWITCH, OTHER, LEAST, LOST = 3.0, 1.0, 1.0, 6.0
#: Nats added for each character, up to three, that the bytes of single-byte text give as valid UTF-8, which hardly ever happens by chance.
VALID_UTF8 = 4.0
#: Evidence in nats at which a document counts half in the next character model; one without evidence counts whole.
DOUBT = 1.0
#: Nats behind the best chain of its part at which a chain's posterior is nothing (under e**-15).
FAR = 15.0
#: Nats: the price of writing a word in capitals.
CAPITALS = 2.0
#: Weight of the overall prior, in documents, within the prior of a source and field; share of garbled parts assumed at first.
PRIOR_DOCS, FIRST_SHARE, ROUNDS, MODEL_ROUNDS = 20.0, 0.02, 12, 2
#: Change of a chain's prior, as a share of itself, below which EM has settled; tasks over which one source's evidence is spread.
SETTLED, SALTS = 0.01, 16
#: Characters of words that are learned or scored at a time, for the memory they take.
PART = 1 << 18
#: Words that a worker remembers before it starts anew; words from which on no further text is learned along with others.
KNOWN, TOGETHER = 400_000, 100_000
REPLACEMENT = "�"
#: Stands for a lost byte in all encodings.
GONE = "\x1a"

SINGLE = ["cp1252", "latin-1", "cp1250", "iso8859-2", "cp1251", "koi8-r", "cp866", "mac-roman", "cp437", "cp850", "cp1253", "cp1254", "cp1256", "iso8859-15"]
ONLY_WRITTEN = ["iso8859-5", "mac-cyrillic", "iso8859-7", "iso8859-9", "iso8859-6"]
MULTI = ["cp932", "gb18030", "cp949", "big5", "euc-jp"]
WESTERN = ["cp1252", "latin-1"]
#: Readings that are one and the same chain: a text shows which of the two it was only in the words that have a control.
ONE = {"latin-1": "cp1252"}
CYRILLIC = ["cp1251", "koi8-r", "cp866", "iso8859-5", "mac-cyrillic"]
#: Which encodings may have been written, by the one the text was read in.
WRITTEN = {
    **{r: [*CYRILLIC, "cp1253", "iso8859-7", "cp1256", "iso8859-6", "cp1254", "cp1250", "iso8859-2", "mac-roman", "cp850", "cp437", *MULTI] for r in WESTERN},
    "cp1250": ["cp1252", "iso8859-2", "cp1251", *MULTI],
    "iso8859-2": ["cp1252", "cp1250", "cp1251"],
    "cp1251": ["cp1252", "cp1250", "koi8-r", "cp866", "iso8859-5", "mac-cyrillic", "cp1253", "cp1254", "cp1256", *MULTI],
    "koi8-r": ["cp1251", "cp866", "iso8859-5", "cp1252"],
    "cp866": ["cp1251", "koi8-r", "cp1252"],
    "mac-roman": ["cp1252", "cp1251", "cp1250", "koi8-r", *MULTI],
    "cp437": ["cp1252", "cp1251", "cp866"],
    "cp850": ["cp1252"],
    "cp1253": ["cp1252"],
    "cp1254": ["cp1252", "cp1250"],
    "cp1256": ["cp1252", "cp1251"],
    "iso8859-15": ["cp1252"],
    "cp932": ["gb18030", "big5", "cp949", "euc-jp"],
    "gb18030": ["cp932", "big5", "cp949", "euc-jp"],
    "cp949": ["cp932", "gb18030", "big5", "euc-jp"],
    "big5": ["cp932", "gb18030", "cp949"],
}
#: Written encodings whose words lie almost wholly beyond ASCII.
DENSE = {*CYRILLIC, "cp1253", "iso8859-7", "cp1256", "iso8859-6"}
#: Marks a chain seen on single signs only, which counts where it explains all of a line that has other words.
ALONE = ", alone"
#: What is left of punctuation in UTF-8 that was read as windows-1252 or its subset and then lost its control characters.
LEFT, LEFT_OF = "â", "’“”–—…"
_REFERENCE = re.compile(r"&#?\w{2,31};?")
_HIGH_CONTROL = re.compile(r"[\x80-\x9f]")
_CHARACTER = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")
_BEYOND = re.compile(r"[^\x00-\x7f]")
_CONTROL = re.compile(r"[\x00-\x08\x0b-\x1f\x7f-\x9f]")


def letters_of(encoding: str) -> str:
    """The 256 characters of a single-byte encoding; unused bytes stand for the control of their number, as browsers read them."""
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(encoding))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


class Undo:
    """Undoes one wrong reading."""

    def __init__(self) -> None:
        self.table = {e: letters_of(e) for e in (*SINGLE, *ONLY_WRITTEN)}
        self.map = {e: codecs.charmap_build(self.table[e]) for e in SINGLE}
        self.lead = {e: re.compile(f"[{re.escape(self.table[e][0xC2:0xF5])}][{re.escape(self.table[e][0x80:0xC0])}]") for e in SINGLE}
        self.run = {e: re.compile(f"[{re.escape(self.table[e] + REPLACEMENT)}]+") for e in SINGLE}

    def bytes_of(self, word: str, read: str) -> bytes | None:
        word = word.replace(REPLACEMENT, GONE)  # the byte is lost; some encodings could write the sign itself
        try:
            return codecs.charmap_encode(word, "strict", self.map[read])[0] if read in self.map else word.encode(read)
        except UnicodeEncodeError:
            return None

    def written(self, raw: bytes, encoding: str) -> tuple[str, int] | None:
        """The text and the number of characters lost, if no more were lost than characters beyond ASCII could be read; of encodings less strict than UTF-8, a tenth of these."""
        if encoding in self.table:
            return codecs.charmap_decode(raw, "strict", self.table[encoding])[0].replace(GONE, REPLACEMENT), 0
        try:
            return raw.decode(encoding).replace(GONE, REPLACEMENT), 0
        except UnicodeDecodeError:
            # most words end here: without a character that can be read, or with too few bytes for the tenth, no more can be lost
            if not _CHARACTER.search(raw) if encoding == "utf-8" else len(raw) < 21:
                return None
            text = raw.decode(encoding, "replace")
            lost = text.count(REPLACEMENT)
            read = len(_BEYOND.findall(text)) - lost
            return (text.replace(REPLACEMENT, "").replace(GONE, REPLACEMENT), lost) if lost * (1 if encoding == "utf-8" else 10) <= read else None

    def cut(self, word: str, chain: str) -> bool:
        """Whether undoing ``chain`` leaves an incomplete character at the end of ``word``."""
        for step in reversed(chain.removesuffix(ALONE).split("+")):
            encoding, _, read = step.partition(">")
            raw = self.bytes_of(word, read) if "," not in read else None
            if raw is None and read in ONE.values():
                raw = self.bytes_of(word, "latin-1")
            if raw is None or encoding in self.table:
                return False
            decoder = codecs.getincrementaldecoder(encoding)("replace")
            word = decoder.decode(raw)
            if decoder.getstate()[0]:
                return True
        return False

    @staticmethod
    def valid(text: str, encoding: str, read: str) -> float:
        return VALID_UTF8 * min(3, sum(c > "\x7f" for c in text)) if encoding == "utf-8" and read in SINGLE else 0.0

    def in_part(self, word: str, read: str) -> tuple[str, float] | None:
        """``word``, which as a whole can't come of a single-byte reading, with those of its longest runs that can come of ``read`` and are UTF-8 read as that, and the bonus less what was lost."""
        out, at, bonus = [], 0, 0.0
        for m in self.run[read].finditer(word):
            got = None if m[0].isascii() else self.written(self.bytes_of(m[0], read), "utf-8")
            if got and got[0] != m[0] and not _CONTROL.search(got[0]):
                out += [word[at : m.start()], got[0]]
                at, bonus = m.end(), bonus + self.valid(got[0], "utf-8", read) - LOST * got[1]
        return ("".join(out) + word[at:], bonus) if at else None

    def steps(self, word: str) -> list[tuple[str, str, float]]:
        """(chain, text, bonus) for every way to undo one wrong reading of ``word``."""
        beyond = sum(c > "\x7f" for c in word)
        dense, several = beyond >= 2 and 2 * beyond >= len(word), beyond >= 2
        out, seen, whole = [], set(), False
        for read in (*SINGLE, *MULTI[:4]):  # whether a word can come of a reading, only encoding it shows: mac-roman has U+F8FF and two ligatures
            name, raw = ONE.get(read, read), self.bytes_of(word, read)
            if raw is None:
                continue
            whole = whole or read in SINGLE
            for encoding in ("utf-8", *WRITTEN[read]):
                if (raw, encoding) in seen or (encoding in DENSE and not dense) or (encoding in MULTI and not several):
                    continue
                alone = read in MULTI and beyond == 1 and encoding == "utf-8"
                if read in MULTI and encoding in MULTI and beyond < 3:  # a character or two read as any other: no evidence
                    continue
                seen.add((raw, encoding))
                if got := self.written(raw, encoding):
                    text, lost = got
                    if alone:  # a sign that became one letter, such as the dot between menu items
                        if all(c <= "\x7f" or unicodedata.category(c)[0] in "PS" for c in text):
                            out.append((f"{encoding}>{read}{ALONE}", text, -LOST * lost))
                        continue
                    if text != word and not _CONTROL.search(text):
                        out.append((f"{encoding}>{name}", text, self.valid(text, encoding, read) - LOST * lost))
            if read == "latin-1" and _HIGH_CONTROL.search(word):  # controls are windows-1252 read as its subset
                text = codecs.charmap_decode(raw, "strict", self.table["cp1252"])[0]
                if text != word and not _CONTROL.search(text):
                    out.append(("cp1252>latin-1", text, VALID_UTF8))
        for read in () if whole else SINGLE:  # UTF-8 needs the character of a first byte before that of a further one
            name = ONE.get(read, read)
            if self.lead[read].search(word) and (got := self.in_part(word, read)) and (name, got[0]) not in seen:
                seen.add((name, got[0]))
                out.append((f"utf-8>{name}", *got))
        return out

    def chains(self, word: str) -> list[tuple[str, str, float]]:
        """One or two wrong readings undone; two only where the later one was of UTF-8."""
        first = self.steps(word)
        # control characters may stand between the two readings
        for read in ("cp1252", "latin-1"):
            raw = self.bytes_of(word, read)
            got = self.written(raw, "utf-8") if raw is not None else None
            if got and got[0] != word and _CONTROL.search(got[0]):
                first.append((f"utf-8>{ONE.get(read, read)}", got[0], self.valid(got[0], "utf-8", read) - LOST * got[1]))
        out = [x for x in first if not _CONTROL.search(x[1])]
        if LEFT in word:
            out += [("utf-8>latin-1, controls lost", word.replace(LEFT, c), 0.0) for c in LEFT_OF]
            if word.count(LEFT) == 2:
                out.append(("utf-8>latin-1, controls lost", word.replace(LEFT, "“", 1).replace(LEFT, "”"), 0.0))
        twice = set()
        for chain, text, bonus in first:
            if chain.startswith("utf-8>") and not text.isascii() and (chain, text) not in twice:
                twice.add((chain, text))
                out += [(f"{c}+{chain}", t, bonus + b) for c, t, b in self.steps(text)]
        return out


@lru_cache(1)
def undo() -> Undo:
    return Undo()


def plain(text: str) -> str:
    """Character references read as what they stand for, also where they were escaped themselves."""
    for _ in range(2):
        if "&" in text and _REFERENCE.search(text):
            text = html.unescape(text)
    return text


def hashed(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the characters, pairs and triples of all words, and where each word starts. Words have two marks before and one after."""
    codes = np.frombuffer("".join(f"\x02\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    starts = np.concatenate(([0], np.cumsum([len(w) + 3 for w in words])))
    a, b, c = codes, np.concatenate(([2], codes[:-1])).astype(np.uint64), np.concatenate(([2, 2], codes[:-2])).astype(np.uint64)
    k1, k2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
    pair = (a * k1) ^ (b * k2)
    triple = (pair * k2) ^ (c * k1)
    return (a % np.uint64(UNI)).astype(np.int64), ((pair * k1) >> np.uint64(44)).astype(np.int64), ((triple * k1) >> np.uint64(43)).astype(np.int64), starts


def count_table(words: Counter) -> np.ndarray:
    table = np.zeros(UNI + BI + TRI)
    items = list(words)
    for at in range(0, len(items), 50_000):
        part = items[at : at + 50_000]
        uni, bi, tri, starts = hashed(part)
        weight = np.repeat([float(words[w]) for w in part], np.diff(starts))
        for bucket, base, size in ((uni, 0, UNI), (bi, UNI, BI), (tri, UNI + BI, TRI)):
            table[base : base + size] += np.bincount(bucket, weight, size)
    return table


def in_parts(words: list[str]) -> Iterator[list[str]]:
    """The words in order, as many at a time as have ``PART`` characters, and at least one."""
    part, size = [], 0
    for w in words:
        if part and size + len(w) > PART:
            yield part
            part, size = [], 0
        part.append(w)
        size += len(w)
    if part:
        yield part


class Model:
    """Log-likelihood of words under the counted characters, pairs and triples, each backed by the shorter one."""

    def __init__(self, table: np.ndarray) -> None:
        self.uni, self.bi, self.tri = table[:UNI], table[UNI : UNI + BI], table[UNI + BI :]
        self.total = max(1.0, float(self.uni.sum()))

    def score(self, words: list[str], own: float = 0.0, ended: bool = True) -> np.ndarray:
        """``own``: what the word itself has added to the counts, and is taken from them. ``ended``: whether it counts that words end where they do."""
        if not words:
            return np.zeros(0)
        uni, bi, tri, starts = hashed(words)
        one = (self.uni[uni] + 0.05) / (self.total + 0.05 * UNI)
        before = np.concatenate(([0], uni[:-1]))
        n1, n2, n3 = self.uni[before], self.bi[bi], self.tri[tri]
        two = (np.maximum(n2 - own, 0.0) + 2.0 * one) / (np.maximum(n1, n2) + 2.0)
        pair_before = np.concatenate(([0], bi[:-1]))
        three = (np.maximum(n3 - own, 0.0) + 2.0 * two) / (np.maximum(self.bi[pair_before], n3) + 2.0)
        logs = np.log(three)
        logs[starts[:-1]] = logs[starts[:-1] + 1] = 0.0  # the marks before a word are certain
        if not ended:
            logs[starts[1:] - 1] = 0.0
        return np.add.reduceat(logs, starts[:-1])

    def best(self, words: list[str], own: float = 0.0, ended: bool = True) -> np.ndarray:
        """The score of a word, or of its lower-case form at a price: capitals are rarer, not stranger."""
        parts = [np.maximum(self.score(p, own, ended), self.score([w.lower() for w in p], own, ended) - CAPITALS) for p in in_parts(words)]
        return np.concatenate(parts) if parts else np.zeros(0)


def words_by_line(text: str) -> Iterator[tuple[int, list[str], bool]]:
    """Number of each line that isn't ASCII, its words that aren't, and whether it has others."""
    for i, line in enumerate(text.split("\n")):
        if not line.isascii():
            words = line.split(" ")
            strange = [w for w in words if not w.isascii()]
            yield i, strange, any(w.isascii() and w.isalpha() for w in words)


def _count(table, key: str):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from tidelog.llm import mojibake as m

        words: Counter = Counter()
        counted = None
        for batch in batches:
            texts = [m.plain(t) for t in batch["text"] if t and ("&" in t or not t.isascii())]
            sets = [{w for _, line, _ in m.words_by_line(t) for w in line} for t in texts]
            if table is None:
                for seen in sets:
                    words.update(seen)
            else:
                for seen, (gains, lost) in zip(sets, m.scorer(table, key).read(texts, sets), strict=True):
                    if not gains and not lost:
                        words.update(seen)
                        continue
                    sound = 1.0 / (1.0 + np.exp(min(30.0, max([0.0, *gains.values()]) + m.LOST * lost) - m.DOUBT))
                    for w in seen:
                        words[w] += sound
            if len(words) > 300_000:
                counted, words = m.count_table(words) + (0 if counted is None else counted), Counter()
        if words:
            counted = m.count_table(words) + (0 if counted is None else counted)
        if counted is not None:
            at = np.nonzero(counted)[0]
            yield pd.DataFrame({"bucket": at.astype(np.int32), "n": counted[at]})

    return count


def corpus_model(documents: DataFrame, rounds: int = MODEL_ROUNDS) -> np.ndarray:
    """The counted tables: a fixed number of buckets, whatever the corpus.

    After a first count of all text, each further round counts a document by how likely it is sound under the model before, so that
    garbled text doesn't teach the model that it is usual.
    """
    spark, table = documents.sparkSession, None
    ship(spark)
    rows = spread(documents.select("text").where("text is not null"))
    for _ in range(rounds):
        sent = None if table is None else spark.sparkContext.broadcast(table)
        counts = rows.mapInPandas(_count(sent, name_of(sent)), "bucket int, n double").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
        table = np.zeros(UNI + BI + TRI, np.float32)  # the counts are at most as many rows
        table[counts["bucket"].to_numpy()] = counts["n"].to_numpy()
    return table


class Scorer:
    """Gains of words, remembered over the texts of a worker."""

    def __init__(self, table: np.ndarray) -> None:
        self.model, self.known = Model(table), {}

    def learn(self, words: set[str]) -> None:
        if len(self.known) > KNOWN:
            self.known.clear()
        new = [w for w in words if w not in self.known]
        for part in (p for at in range(0, len(new), 2_000) for p in in_parts(new[at : at + 2_000])):
            ways = [undo().chains(w.strip(REPLACEMENT)) for w in part]
            own = self.model.best([w.strip(REPLACEMENT) for w in part], 1.0)
            flat = self.model.best([t for way in ways for _, t, _ in way])
            k = 0
            for w, way, base in zip(part, ways, own, strict=True):
                best: dict[str, tuple[float, str]] = {}
                for chain, text, bonus in way:
                    gain = float(flat[k] - base) + bonus
                    k += 1
                    if gain > LEAST and gain > best.get(chain, (0.0, ""))[0]:
                        best[chain] = (gain, text)
                self.known[w] = best

    def read(self, texts: list[str], words: list[set[str]]) -> Iterator[tuple[dict[tuple[str, str], float], int]]:
        """Evidence of each text. The words of some texts are learned at once, and known until these are read."""
        at = 0
        while at < len(texts):
            end, together = at, set()
            while end < len(texts) and (end == at or len(together) < TOGETHER):
                together |= words[end]
                end += 1
            self.learn(together)
            yield from map(self.evidence, texts[at:end])
            at = end

    def maybe_cut(self, word: str) -> dict[str, tuple[float, str]]:
        """The gains of a word that may go on: what speaks for a chain also if nothing is made of the word's end."""
        known, out, w = self.known[word], {}, word.strip(REPLACEMENT)
        ways = [x for x in undo().chains(w) if x[0] in known] if known else []
        for (chain, text, bonus), score in zip(ways, self.model.best([t for _, t, _ in ways], ended=False), strict=True):
            gain = min(known[chain][0], float(score - self.model.best([w], 1.0, False)[0]) + bonus)
            if gain > LEAST and gain > out.get(chain, (0.0, ""))[0]:
                out[chain] = (gain, text)
        return out

    def evidence(self, text: str) -> tuple[dict[tuple[str, str], float], int]:
        """Evidence by (field, chain), and the characters lost within the text."""
        lines = list(words_by_line(text))
        end = lines[-1][0] if lines and text.endswith(lines[-1][1][-1]) and sum(len(line) for _, line, _ in lines) > 1 else None
        last = text.rstrip().count("\n")
        out: dict[tuple[str, str], float] = {}
        for i, line, others in lines:
            gains = [self.known[w] for w in line]
            if i == end:
                gains[-1] = self.maybe_cut(line[-1])
            if not any(gains):
                continue
            field = "head" if i == 0 else "tail" if i >= last else "body"
            for chain in {c for g in gains for c in g}:
                # cut within a character, the last word is like no other
                read = gains[:-1] if i == end and undo().cut(line[-1], chain) else gains
                if chain.endswith(ALONE) and not (all(chain in g for g in read) and others):
                    continue
                best = run = 0.0
                for g in read:
                    run = max(0.0, run + (g[chain][0] if chain in g else -OTHER))
                    best = max(best, run)
                if best > SWITCH:
                    out[field, chain] = out.get((field, chain), 0.0) + best - SWITCH
        return out, text.rstrip().rstrip(REPLACEMENT).count(REPLACEMENT)


_scorers: dict[str, Scorer] = {}


def name_of(sent) -> str:
    return "" if sent is None else f"{sent._jbroadcast.toString()}"


def scorer(table, key: str) -> Scorer:
    """The scorer of this process for a broadcast model; a worker keeps it over its tasks."""
    if key not in _scorers:
        _scorers.clear()
        _scorers[key] = Scorer(table.value)
    return _scorers[key]


EVIDENCE = "doc_id bigint, source string, field string, chain string, gain double"


def _score(table, key: str):
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from tidelog.llm import mojibake as m

        scorer = m.scorer(table, key)
        for batch in batches:
            rows = []
            texts = [m.plain(t) if t and ("&" in t or not t.isascii()) else "" for t in batch["text"]]
            sets = [{w for _, line, _ in m.words_by_line(t) for w in line} for t in texts]
            for doc_id, source, (gains, lost) in zip(batch["doc_id"], batch["source"], scorer.read(texts, sets), strict=True):
                top = {f: max(g for (x, _), g in gains.items() if x == f) for f in {f for f, _ in gains}}
                rows += [(doc_id, source, f, c, g) for (f, c), g in gains.items() if g > top[f] - m.FAR]
                if lost:
                    rows.append((doc_id, source, "body", "lost", m.LOST * (lost + 1)))
            yield pd.DataFrame(rows, columns=["doc_id", "source", "field", "chain", "gain"])

    return score


def evidence(documents: DataFrame, table: np.ndarray | None = None) -> DataFrame:
    """Gain of every chain that would improve a field of a document."""
    spark = documents.sparkSession
    table = corpus_model(documents) if table is None else table
    ship(spark)
    sent = spark.sparkContext.broadcast(table)
    rows = spread(documents.where("doc_id is not null and text is not null").select("doc_id", "source", "text"))
    return rows.mapInPandas(_score(sent, name_of(sent)), EVIDENCE)


def posteriors(scored: DataFrame, documents: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """EM over the evidence: doc_id, field, chain and posterior of each chain of each part that has evidence.

    Ends when no chain's share of the parts changes by more than ``SETTLED`` of itself, or after ``rounds``.
    """
    spark = scored.sparkSession
    part = ["doc_id", "source", "field"]
    salted = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")  # a hot source is spread over so many tasks
    pages = documents.groupBy(F.coalesce("source", F.lit("")).alias("source"), salted.alias("salt")).agg(F.count_distinct("doc_id").alias("n"))
    pages = materialize(pages.groupBy("source").agg(F.sum("n").alias("n_docs")), "mojibake-sources")
    n = pages.agg(F.coalesce(F.sum("n_docs"), F.lit(0))).first()[0] or 1
    is_hot = F.col("n_docs") > max(SALTS, n // HOT_KEYS)
    hot = F.broadcast(pages.where(is_hot).select("source", F.col("n_docs").alias("hot_docs")))  # fewer than HOT_KEYS rows
    told = scored.withColumn("source", F.coalesce("source", F.lit(""))).join(hot, "source", "left").withColumn("salt", F.when(F.col("hot_docs").isNotNull(), salted + 1).otherwise(0))
    told = told.join(pages.where(~is_hot).withColumn("salt", F.lit(0)).hint("merge"), ["source", "salt"], "left")
    scored = materialize(told.withColumn("n_docs", F.coalesce("hot_docs", "n_docs")).drop("hot_docs"), "mojibake")
    salts = F.explode(F.when(F.col("hot"), F.array(*map(F.lit, range(1, SALTS + 1)))).otherwise(F.array(F.lit(0)))).alias("salt")
    chains = [r["chain"] for r in scored.select("chain").distinct().collect()]  # the inventory of chains bounds this
    overall = dict.fromkeys(chains, FIRST_SHARE / max(1, len(chains)))
    local: DataFrame | None = None
    for k in range(rounds):
        general = spark.createDataFrame(list(overall.items()), "chain string, general double")  # a row per chain
        prior = scored.join(F.broadcast(general), "chain")
        if local is not None:
            prior = prior.join(local.select("source", "field", "chain", "weight", salts).hint("merge"), ["source", "field", "chain", "salt"], "left")
            prior = prior.withColumn("prior", (F.coalesce("weight", F.lit(0.0)) + PRIOR_DOCS * F.col("general")) / (F.col("n_docs") + PRIOR_DOCS)).drop("weight")
        else:
            prior = prior.withColumn("prior", F.col("general"))
        # what isn't garbled is sound, with a gain of 0
        odds = prior.withColumn("odds", F.exp(F.least(F.col("gain") + F.log("prior"), F.lit(300.0))))
        whole = odds.groupBy(*part).agg(F.sum("odds").alias("all"), F.collect_list(F.struct("chain", "gain", "odds", "salt")).alias("ways"))  # as many as there are chains at most
        answer = whole.select(*part, "all", F.explode("ways").alias("w")).select(*part, "w.chain", "w.gain", "w.salt", (F.col("w.odds") / (F.col("all") + 1.0)).alias("posterior"))
        if k == rounds - 1:
            break
        local = materialize(answer.groupBy("source", "field", "chain", (F.col("salt") > 0).alias("hot")).agg(F.sum("posterior").alias("weight")), f"mojibake-em{k}")
        seen = {r["chain"]: r["w"] for r in local.groupBy("chain").agg(F.sum("weight").alias("w")).collect()}
        was, overall = overall, {c: (seen.get(c, 0.0) + FIRST_SHARE) / (3.0 * n + len(chains)) for c in chains}
        if k and all(abs(overall[c] - was[c]) <= SETTLED * was[c] for c in chains):
            break  # the answer above is that of priors which the next round wouldn't move
    return answer.select(*part, "chain", "gain", "posterior")


def garbled(documents: DataFrame) -> DataFrame:
    """doc_id of every document that is garbled, in whole or in part."""
    sure = posteriors(evidence(documents), documents).groupBy("doc_id", "field").agg(F.sum("posterior").alias("p"))
    return sure.where("p > 0.5").select("doc_id").distinct()


def _repair(table, key: str):
    def repair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from tidelog.llm import mojibake as m

        scorer = m.scorer(table, key)
        for batch in batches:
            out = []
            for text, ways in zip(batch["text"], batch["ways"], strict=True):
                allowed: dict[str, set[str]] = {}
                for w in ways:
                    allowed.setdefault(w["field"], set()).add(w["chain"])
                read = {w: p for line in text.split("\n") for w in line.split(" ") if not (p := m.plain(w)).isascii()}  # as written, and with its references read
                scorer.learn(set(read.values()))
                last, lines, any_ = m.plain(text).rstrip().count("\n"), [], {w["chain"] for w in ways}
                for i, line in enumerate(text.split("\n")):
                    mine = allowed.get("head" if i == 0 else "tail" if i >= last else "body", set())

                    def fixed(word: str, mine=mine, any_=any_, read=read) -> str:
                        # a chain that only another field shows must be worth the price of a change
                        found = [g for c, g in scorer.known.get(read.get(word, ""), {}).items() if c in mine or (c in any_ and g[0] > m.SWITCH)]
                        return max(found)[1] if found else word  # a sound word stays as it is written, references included

                    lines.append(" ".join(map(fixed, line.split(" "))))
                out.append("\n".join(lines))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "chains": [sorted({w["chain"] for w in ways}, key=lambda c, ways=ways: (-max(w["p"] for w in ways if w["chain"] == c), c)) for ways in batch["ways"]], "repaired": out})

    return repair


def repaired(documents: DataFrame) -> DataFrame:
    """Found documents with their chains (most likely first) and the text restored as far as possible: each field by the chains of its own posterior, and
    by those of others where a word gains more than the price of a change."""
    spark, table = documents.sparkSession, corpus_model(documents)
    post = posteriors(evidence(documents, table), documents)
    parts = post.groupBy("doc_id", "field").agg(F.sum("posterior").alias("found"), F.max("posterior").alias("top"), F.collect_list(F.struct("posterior", "chain")).alias("ways"))
    kept = parts.select("doc_id", "field", "found", "top", F.explode("ways").alias("way")).where("way.posterior > 0.2 or (found > 0.5 and way.posterior = top)")  # the best of a found part, however many are like it
    by_doc = kept.groupBy("doc_id").agg(F.max("found").alias("found"), F.collect_list(F.struct("field", "way.chain", F.col("way.posterior").alias("p"))).alias("ways"))
    wanted = by_doc.where("found > 0.5").drop("found")
    sent = spark.sparkContext.broadcast(table)
    rows = documents.select("doc_id", "text").where("text is not null").join(wanted, "doc_id").dropDuplicates(["doc_id"])
    return rows.mapInPandas(_repair(sent, name_of(sent)), "doc_id bigint, chains array<string>, repaired string")
