"""One consistent form for texts that look the same.

A text is first brought to one width, without ignorable characters and with plain spaces;
then each word is a lattice: every letter may be any of the letters of its shape, and a
Viterbi search takes the path that the script-consistent bigrams of the whole corpus find
most likely. All letters of a shape are admitted alike, whichever the text had, so words
that look the same get the same path.
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

# Letters of the same shape as the letter of the basic Latin alphabet beside
# them, from the Cyrillic, Greek, Armenian, Cherokee, Lisu and number-form blocks.
TWINS = {
    "A": "ΑАᎪꓮ",
    "B": "ΒВᏴꓐ",
    "C": "ϹСᏟꓚⅭ",
    "D": "ᎠꓓⅮ",
    "E": "ΕЕᎬꓰ",
    "F": "ꓝ",
    "G": "ԌᏀꓖ",
    "H": "ΗНᎻꓧ",
    "I": "ΙІӀꓲⅠ",
    "J": "ͿЈᎫꓙ",
    "K": "ΚКᏦꓗ",
    "L": "ᏞꓡⅬ",
    "M": "ΜМᎷꓟⅯ",
    "N": "Νꓠ",
    "O": "ΟОՕꓳ",
    "P": "ΡРᏢꓑ",
    "Q": "Ԛ",
    "R": "Ꭱꓣ",
    "S": "ЅᏚꓢ",
    "T": "ΤТᎢꓔ",
    "V": "ᏙꓦⅤ",
    "W": "ԜᎳꓪ",
    "X": "ΧХꓫⅩ",
    "Y": "ΥҮꓬ",
    "Z": "ΖᏃꓜ",
    "a": "а",
    "c": "ϲсⅽ",
    "d": "ԁⅾ",
    "e": "е",
    "g": "ɡ",
    "h": "һ",
    "i": "іⅰ",
    "j": "ϳј",
    "l": "ӏⅼ",
    "m": "ⅿ",
    "o": "οоօ",
    "p": "р",
    "q": "ԛ",
    "s": "ѕ",
    "v": "ѵⅴ",
    "w": "ԝ",
    "x": "хⅹ",
    "y": "у",
    "μ": "µ",
    # shapes that Greek and Cyrillic share without Latin
    "Γ": "Г",
    "Π": "П",
    "Φ": "Ф",
}

#: The letter that stands for each shape.
SHAPE = {twin: letter for letter, twins in TWINS.items() for twin in twins}
MEMBERS = {letter: sorted({letter, *twins}) for letter, twins in TWINS.items()}

_JOINER = "\u200d"
_EDGE = "\0"
#: Letters of the scripts that have twins, with the marks that may follow them.
_WORD = re.compile("[A-Za-z\u00aa-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0250-\u02af\u0300-\u036f\u0370-\u03ff\u0400-\u052f\u0531-\u0587\u13a0-\u13fd\u1e00-\u1fff\u2160-\u217f\ua4d0-\ua4f7]+")
#: Code points below this have a place in the bigram table.
_TABLE_END = 0xA500


def _invisible(o: int) -> bool:
    c = chr(o)
    kind = unicodedata.category(c)
    return (kind in ("Cf", "Cc") and c not in "\t\n\r" and not 0x600 <= o <= 0x605 and o != 0x6DD) or o in (0x34F, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F) or 0xFE00 <= o <= 0xFE0D


@lru_cache(maxsize=1)
def _folding() -> tuple[dict[int, str | None], re.Pattern[str]]:
    """By rule: full and half width to the usual width, space kinds to the space, ignorable characters to nothing."""
    fold: dict[int, str | None] = {}
    for o in [*range(0x3100), *range(0xFE00, 0x10000), *range(0xE0000, 0xE0080)]:
        c = chr(o)
        kind = unicodedata.decomposition(c).split(" ")
        if kind[0] in ("<wide>", "<narrow>"):
            fold[o] = "".join(chr(int(x, 16)) for x in kind[1:])
        elif unicodedata.category(c) == "Zs" and o not in (0x20, 0x1680):
            fold[o] = " "
        elif _invisible(o) and c != _JOINER:
            fold[o] = None
        elif 0x2160 <= o <= 0x217F:  # number forms of several letters look like those letters
            plain = unicodedata.normalize("NFKC", c)
            if len(plain) > 1:
                fold[o] = plain
    return fold, re.compile("[" + _JOINER + "".join(re.escape(chr(o)) for o in sorted(fold)) + "]")


def _pictograph(c: str) -> bool:
    return c in "\ufe0f\u2640\u2642" or unicodedata.category(c) in ("So", "Sk")


def folded(text: str) -> str:
    """Compatibility folding that keeps the look: width, spaces, ignorable characters, separate accents.

    A joiner between pictographs changes their look and stays; raised and circled digits stay.
    """
    if text.isascii():
        return text.translate(_ASCII_CONTROLS) if _ASCII_CONTROL.search(text) else text
    table, special = _folding()
    if special.search(text):
        if _JOINER in text:
            cut = text.split(_JOINER)
            text = cut[0]
            for part in cut[1:]:
                joined = text and part and _pictograph(text[-1]) and _pictograph(part[0])
                text += (_JOINER if joined else "") + part
        text = text.translate(table)
    return unicodedata.normalize("NFD", text)


_ASCII_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")
_ASCII_CONTROLS = dict.fromkeys([*range(9), 11, 12, *range(14, 32), 127])


def _script(c: str) -> str:
    name = unicodedata.name(c, "?")
    return name.split(" ")[0].replace("MICRO", "GREEK")


@lru_cache(maxsize=1)
def _alphabet() -> tuple[list[str], np.ndarray, np.ndarray]:
    """Letters of the bigram table (0 is anything else), the place of each code point, and the script of each letter."""
    letters = sorted({*"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", *SHAPE, *TWINS, *map(chr, range(0x391, 0x3CA)), *map(chr, range(0x410, 0x450))} - {"\u03a2"})
    place = np.zeros(_TABLE_END, dtype=np.int32)
    at = {c: i + 1 for i, c in enumerate(letters)}
    for o in range(_TABLE_END):
        base = unicodedata.normalize("NFD", chr(o))[0] if o < 0x530 else chr(o)
        place[o] = at.get(base, 0)
    names = ["", *(_script(c) for c in letters)]
    ids = {s: i for i, s in enumerate(sorted(set(names)))}
    return [_EDGE, *letters], place, np.array([ids[s] for s in names])


def bigram_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(first, second, n) over all texts: pairs of neighbouring letters of one script; U+0000 is the edge of a word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, place, script = _alphabet()
        k = len(letters)
        total = np.zeros(k * k, dtype=np.int64)
        for batch in batches:
            whole = "\n".join(t for t in batch.column(0).to_pylist() if t)
            points = np.frombuffer(f"\n{whole}\n".encode("utf-32-le", "replace"), dtype=np.uint32)
            at = place[np.where(points < _TABLE_END, points, 0)]
            total += np.bincount(at[:-1] * k + at[1:], minlength=k * k)
        pairs = np.flatnonzero(total)
        a, b = pairs // k, pairs % k
        fit = (script[a] == script[b]) | (a == 0) | (b == 0)
        fit &= (a > 0) | (b > 0)
        a, b, n = a[fit], b[fit], total[pairs[fit]]
        yield pa.RecordBatch.from_arrays([pa.array([letters[i] for i in a], pa.string()), pa.array([letters[i] for i in b], pa.string()), pa.array(n)], names=["first", "second", "n"])

    return docs.select(text).mapInArrow(count, "first string, second string, n long").groupBy("first", "second").agg(F.sum("n").alias("n"))


class Speller:
    """The most likely spelling of a word among those that look like it."""

    #: Words that are kept with their spelling.
    KEPT = 200_000

    def __init__(self, counts: dict[tuple[str, str], int]):
        firsts: dict[str, int] = {}
        for (a, _), n in counts.items():
            firsts[a] = firsts.get(a, 0) + n
        size = len(_alphabet()[0])
        self.score = {p: math.log((n + 0.1) / (firsts[p[0]] + 0.1 * size)) for p, n in counts.items()}
        self.unseen = {a: math.log(0.1 / (n + 0.1 * size)) for a, n in firsts.items()}
        self.never = math.log(1.0 / size)
        self.scripts = {c: _script(c) for members in MEMBERS.values() for c in members}
        self.known: dict[str, str] = {}

    def _step(self, a: str, b: str) -> float:
        got = self.score.get((a, b))
        if got is None:
            got = self.unseen.get(a, self.never)
            if a != _EDGE and b != _EDGE and self.scripts.get(a) != self.scripts.get(b):
                got -= 20.0  # a change of script inside a word
        return got

    def viterbi(self, word: str) -> str:
        paths: dict[str, tuple[float, str]] = {_EDGE: (0.0, "")}
        for c in word:
            if "\u0300" <= c <= "\u036f":  # a mark follows whatever letter is chosen
                paths = {a: (s, p + c) for a, (s, p) in paths.items()}
                continue
            c = SHAPE.get(c, c)
            if c not in self.scripts:
                self.scripts[c] = _script(c)
            options = MEMBERS.get(c)
            if options is None:
                best = max((s + self._step(a, c), a) for a, (s, _) in paths.items())
                paths = {c: (best[0], paths[best[1]][1] + c)}
                continue
            new = {}
            for b in options:
                best = max((s + self._step(a, b), a) for a, (s, _) in paths.items())
                new[b] = (best[0], paths[best[1]][1] + b)
            paths = new
        return min((-(s + self._step(a, _EDGE)), p) for a, (s, p) in paths.items())[1]

    def word(self, match: re.Match[str]) -> str:
        w = match.group()
        got = self.known.get(w)
        if got is None:
            got = self.viterbi(w)
            if len(w) <= 40:
                if len(self.known) >= self.KEPT:
                    self.known.clear()
                self.known[w] = got
        return got

    def text(self, text: str) -> str:
        return unicodedata.normalize("NFC", _WORD.sub(self.word, folded(text)))


def consistent_forms(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """(doc_id, form_key, text_key) of every text with a visible character; ``with_text`` adds ``form`` itself.

    Texts that look the same have one form and so one ``form_key`` (128 bits of a digest);
    ``text_key`` tells different strings apart. The bigram table is collected: it is bounded by
    the square of the alphabet, whatever the number of documents.

    Defined cases: null, empty and blank texts, and texts of ignorable characters only, have no
    row; case, digits, raised or circled digits and missing accents stay visible differences;
    whole texts are read; repeated rows stay repeated; other columns are ignored.
    """
    counts = {(r["first"], r["second"]): r["n"] for r in bigram_counts(docs, text).collect()}
    shared = docs.sparkSession.sparkContext.broadcast(counts)
    kind = dict(docs.dtypes)[doc_id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speller = Speller(shared.value)
        for batch in batches:
            ids, keys, raws, forms = [], [], [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                form = speller.text(t) if t else ""
                if not form.strip():
                    continue
                ids.append(i)
                keys.append(hashlib.blake2b(form.encode("utf-8", "replace"), digest_size=16).digest())
                raws.append(hashlib.blake2b(t.encode("utf-8", "replace"), digest_size=16).digest())
                if with_text:
                    forms.append(form)
            out = [pa.array(ids, batch.column(0).type), pa.array(keys, pa.binary()), pa.array(raws, pa.binary())]
            yield pa.RecordBatch.from_arrays([*out, *([pa.array(forms, pa.string())] if with_text else [])], names=["doc_id", "form_key", "text_key", *["form"] * with_text])

    return docs.select(doc_id, text).mapInArrow(run, f"doc_id {kind}, form_key binary, text_key binary" + ", form string" * with_text)


def same_looking_pairs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id_a, doc_id_b), a < b: documents whose texts differ as strings but have one form.

    Only forms with at least two different strings are joined; exact copies are no pairs.
    """
    # written once: it is read three times, and is small beside the texts
    forms = written(consistent_forms(docs, doc_id, text).where(F.col("doc_id").isNotNull()), "text-forms").distinct()
    several = forms.groupBy("form_key").agg(F.min("text_key").alias("low"), F.max("text_key").alias("high")).where("low <> high").select("form_key")
    kept = forms.join(several, "form_key", "left_semi")
    a, b = kept.alias("a"), kept.alias("b")
    return a.join(b, (F.col("a.form_key") == F.col("b.form_key")) & (F.col("a.text_key") != F.col("b.text_key")) & (F.col("a.doc_id") < F.col("b.doc_id"))).select(
        F.col("a.doc_id").alias("doc_id_a"), F.col("b.doc_id").alias("doc_id_b")
    )


def same_looking_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, class_id, links): each document that looks like another but is written differently.

    ``class_id`` is the smallest id of its class, ``links`` how many documents of the class have other
    characters. One row a document, however many look alike: nothing is paired, and classes are
    counted by their forms and strings before they meet the documents.
    """
    forms = written(consistent_forms(docs, doc_id, text).where(F.col("doc_id").isNotNull()), "text-forms").distinct()
    strings = forms.groupBy("form_key", "text_key").agg(F.count("*").alias("same"), F.min("doc_id").alias("low"))
    classes = strings.groupBy("form_key").agg(F.sum("same").alias("all"), F.min("low").alias("class_id"), F.count("*").alias("spellings")).where("spellings > 1").drop("spellings")
    counted = strings.join(classes, "form_key").select("form_key", "text_key", "class_id", (F.col("all") - F.col("same")).alias("links"))
    return forms.join(counted, ["form_key", "text_key"]).select("doc_id", "class_id", "links")
