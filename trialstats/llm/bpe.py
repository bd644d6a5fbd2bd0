"""Byte-pair encoding and decoding of whole texts, exactly as the tokenizers library does it.

A text of up to ``LEAF`` characters is encoded where it lies: its words are looked up in a bounded store of words that were met
before, and the library encodes the others. A longer text is cut into halves, and these again, wherever the middle happens to
be, inside a word or not. The leaves are dealt over all tasks and encoded apart. Then halves are joined up the tree: a window
around the join is encoded anew, and grows until it shares a token with what is left of the join and one with what is right of
it. The result is the left half up to the first, the window between them, and the right half from the second on.

Why that is exact: every node holds what the library makes of that piece of text alone. Scanning for words goes from
left to right and looks ahead ``reach`` characters at most, so what is shared far enough from an end was cut into words
alike. And a list of tokens is the encoding of a word if each two neighbours are the encoding of their two texts: all
neighbours in the result are neighbours in the left half, in the window or in the right half.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trialstats.llm.common import join_same, whole_text
from trialstats.session import stored_table

# Characters of a leaf: longer texts are halved. Characters on either side of a join that are encoded anew at first.
LEAF = 16_384
WINDOW = 64
# Words that a task holds; beyond, it forgets all and starts again.
WORDS = 400_000

# Characters that are told apart without the library: all below, but for those that it lower-cases or splits in another way.
_PLAIN_END = 0x250
_CHUNK = re.compile(r"[^ \t\n\r\x0b\x0c]+")


def starts_afresh(char: str) -> bool:
    """No character before changes how this one is normalised: it is no mark, and no part of a syllable that goes on."""
    return unicodedata.category(char)[0] != "M" and not "\u1160" <= char <= "\u11ff" and not "\ud7b0" <= char <= "\ud7ff"


@dataclass(frozen=True)
class Piece:
    """Tokens of a piece of text, and where each starts and ends in the text."""

    ids: np.ndarray
    start: np.ndarray
    end: np.ndarray

    def clean(self) -> np.ndarray:
        """Tokens that share no character with a neighbour, as parts of one character do."""
        n = len(self.ids)
        free = np.ones(n, bool)
        free[1:] = self.start[1:] >= self.end[:-1]
        free[:-1] &= free[1:]
        return free & (self.start < self.end)


class Coder:
    """One vocabulary of the library, with words met before."""

    def __init__(self, vocabulary: str):
        self.library = Tokenizer.from_str(vocabulary)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        tokens = self.library.get_vocab(with_added_tokens=True)
        self.token = {i: t for t, i in tokens.items()}
        #: Ids between tasks, two bytes each where that holds them.
        self.packed = np.uint16 if max(self.token, default=0) < 1 << 16 else np.int32
        added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        #: How far the library looks ahead for the end of a word or of an added token.
        self.reach = max([4, *map(len, added)])
        self._added = re.compile("|".join(map(re.escape, added)) if added else r"(?!)")
        form = json.loads(vocabulary)
        form = json.dumps([form.get("normalizer"), form.get("pre_tokenizer")])
        #: Whether words end at blanks and blanks are dropped, so that no token reaches over one.
        self.blanks_part = hashlib.sha256(form.encode()).hexdigest() == _WORD_FORM
        self._byte: dict[int, str] = {}
        self._plain, self._word = self._alphabet() if self.blanks_part else (re.compile(r"(?!)"), re.compile(r"(?!)"))
        self._seen: dict[str, tuple[int, str, str]] = {}

    def _alphabet(self) -> tuple[re.Pattern, re.Pattern]:
        """Texts of plain characters, and their words, by asking the library about each character."""
        split, lower = self.library.pre_tokenizer.pre_tokenize_str, self.library.normalizer.normalize_str
        letters, others, odd = [], [], []
        for c in map(chr, range(_PLAIN_END)):
            if lower(c) != (" " if c.isspace() and not split(c) else c.lower()) or len(c.lower()) > 1:
                odd.append(c)
            elif not split(c):
                if c not in " \t\n\r\x0b\x0c":
                    odd.append(c)
            elif len(split("a" + c)) == 1:
                letters.append(c)
            elif len(split("!" + c)) == 1:
                others.append(c)
            elif not c.isdigit() or not c.isascii():
                odd.append(c)
        # How the library writes each byte of these characters.
        for c in [*letters, *others, *map(str, range(10))]:
            self._byte.update(zip(c.encode(), split(c)[0][0], strict=True))
        plain = "".join(map(re.escape, letters + others)) + r"0-9 \t\n\r\x0b\x0c"
        word = rf"'s|'t|'re|'ve|'m|'ll|'d|[{''.join(map(re.escape, letters))}]+|[0-9]|[{''.join(map(re.escape, others))}]+"
        return re.compile(f"[{plain}]*"), re.compile(word)

    def _entries(self, text: str) -> list[tuple[int, str, str]]:
        """Of each word, or of what stands between blanks: number of ids, and their decimal and token texts."""
        if self._plain.fullmatch(text) and not self._added.search(text):
            return self._looked_up(self._word.findall(text.lower()), self._word_ids)
        # No word, added token or composed character reaches over a blank.
        return self._looked_up(_CHUNK.findall(text) if self.blanks_part else [text], self._library_ids)

    def _looked_up(self, words: list[str], encode: Callable[[str], list[int]]) -> list[tuple[int, str, str]]:
        entries = list(map(self._seen.get, words))
        if None in entries:
            for at, entry in enumerate(entries):
                if entry is None:
                    entries[at] = self._seen.get(words[at]) or self._learnt(words[at], encode)
        return entries

    def _learnt(self, word: str, encode: Callable[[str], list[int]]) -> tuple[int, str, str]:
        if len(self._seen) >= WORDS:
            self._seen.clear()
        ids = encode(word)
        entry = self._seen[word] = (len(ids), " ".join(map(str, ids)), " ".join([self.token[i] for i in ids]))
        return entry

    def _word_ids(self, word: str) -> list[int]:
        """Of a word of plain characters: it is all that the library would cut, so its bytes go to the merges at once."""
        return [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self._byte))]

    def _library_ids(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def ids(self, text: str) -> list[int]:
        return [int(i) for entry in self._entries(text) for i in entry[1].split()]

    def digests(self, text: str) -> tuple[int, str, str]:
        """Number of tokens, SHA-256 of their ids and of the decoded text."""
        entries = self._entries(text)
        if not entries:
            return 0, _sha256(""), _sha256("")
        sizes, ids, decoded = zip(*entries, strict=True)
        if 0 in sizes:  # blanks that no word is made of
            ids, decoded = filter(None, ids), filter(None, decoded)
        return sum(sizes), _sha256(" ".join(ids)), _sha256(" ".join(decoded))

    def decoded(self, ids: np.ndarray) -> str:
        """What the library's decode gives where the vocabulary has no decoder of its own; else its decode."""
        ids = [int(i) for i in ids]
        if self.library.decoder is not None:
            return self.library.decode(ids, skip_special_tokens=False)
        return " ".join([self.token[i] for i in ids if i in self.token])

    def piece(self, text: str, at: int = 0) -> Piece:
        """The library's encoding of a piece of a text that starts at ``at``."""
        found = self.library.encode(text, add_special_tokens=False)
        places = np.array(found.offsets, np.int64).reshape(-1, 2) + at
        return Piece(np.array(found.ids, np.int32), places[:, 0], places[:, 1])


# Fixed value: SHA-256 of the normaliser and the splitter of the vocabulary that ``Coder._word`` is written for.
_WORD_FORM = "60cc08736af293baee1871d6f385bfd7c301c319a472980bf8d1ce4d53942bdb"


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def middle(text: str, a: int, b: int) -> int | None:
    """Where a piece is halved: the first place from its middle on that starts afresh, if there is one."""
    return next((i for i in range((a + b) // 2, b) if i > a and starts_afresh(text[i])), None)


def leaves(text: str, leaf: int = LEAF) -> list[tuple[int, int]]:
    """Ends of the leaves of a text, in order."""
    out, todo = [], [(0, len(text))]
    while todo:
        a, b = todo.pop()
        cut = middle(text, a, b) if b - a > leaf else None
        if cut is None:
            out.append((a, b))
        else:
            todo += [(cut, b), (a, cut)]
    return out


def _shared(left: Piece, right: Piece, least: int, most: int) -> tuple[int, int] | None:
    """Places of the first token between two places of the text that stands in both pieces."""
    places = {
        (int(left.ids[i]), int(left.start[i]), int(left.end[i])): int(i)
        for i in np.flatnonzero(left.clean() & (left.start >= least) & (left.end <= most))
    }
    for j in np.flatnonzero(right.clean() & (right.start >= least) & (right.end <= most)):
        i = places.get((int(right.ids[j]), int(right.start[j]), int(right.end[j])))
        if i is not None:
            return i, int(j)
    return None


def _tail(coder: Coder, text: str, a: int, cut: int, window: int) -> Piece:
    """The last tokens of ``text[a:cut]``, from a blank on that is ``window`` before the cut; all where no blank is."""
    blank = max(text.rfind(" ", a, max(cut - window, a)), text.rfind("\n", a, max(cut - window, a))) if coder.blanks_part else -1
    low = a if blank < 0 else blank
    return coder.piece(text[low:cut], low)


def _head(coder: Coder, text: str, cut: int, c: int, window: int) -> Piece:
    """The first tokens of ``text[cut:c]``, up to a blank that is ``window`` behind the cut; all where no blank is."""
    blanks = [x for x in (text.find(" ", cut + window, c), text.find("\n", cut + window, c)) if x >= 0] if coder.blanks_part else []
    high = min(blanks, default=c)
    return coder.piece(text[cut:high], cut)


def joined(coder: Coder, text: str, ends: tuple[int, int, int], left: np.ndarray, right: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """The ids of ``text[a:c]`` from those of ``text[a:cut]`` and ``text[cut:c]``; ``ends`` are a, cut and c.

    Where the tokens next to the cut lie in the text is found by encoding their side of it again, from or to a blank.
    """
    a, cut, c = ends
    while True:
        tail, head = _tail(coder, text, a, cut, 2 * window), _head(coder, text, cut, c, 2 * window)
        before = tail.start[tail.clean() & (tail.start <= cut - window)][::-1]
        low = next((int(s) for s in before if starts_afresh(text[s])), a)
        after = head.end[head.clean() & (head.end >= cut + window)]
        high = next((int(e) for e in after if e == c or starts_afresh(text[e])), c)
        between = coder.piece(text[low:high], low)
        # At an end of the piece itself nothing has to agree.
        first = (-1, -1) if low == a else _shared(tail, between, low, cut - coder.reach)
        last = (len(between.ids), len(head.ids)) if high == c else _shared(between, head, cut + coder.reach, high - coder.reach)
        if first is not None and last is not None:
            (i, p), (q, j) = first, last
            kept = left[: len(left) - len(tail.ids) + i + 1] if low > a else left[:0]
            rest = right[j:] if high < c else right[:0]
            return np.concatenate([kept, between.ids[p + 1 : q], rest])
        window *= 2


def concatenated(coder: Coder, text: str, pieces: list[np.ndarray], ends: list[tuple[int, int]], window: int = WINDOW) -> np.ndarray:
    """The ids of all leaves of a text joined up the tree that cut it."""
    held: list[tuple[int, int, np.ndarray]] = []
    for (a, end), ids, depth in zip(ends, pieces, _depths(text, ends), strict=True):
        held.append((a, depth, ids))
        while len(held) > 1 and held[-1][1] == held[-2][1]:
            cut, below, right = held.pop()
            start, _, left = held.pop()
            held.append((start, below - 1, joined(coder, text, (start, cut, end), left, right, window)))
    return held[0][2]


def _depths(text: str, ends: list[tuple[int, int]]) -> list[int]:
    """How deep each leaf hangs: the tree is cut again, down to the leaves that are there."""
    out, todo, there = [], [(0, len(text), 0)], set(ends)
    while todo:
        a, b, depth = todo.pop()
        if (a, b) in there:
            out.append(depth)
        else:
            cut = middle(text, a, b)
            todo += [(cut, b, depth + 1), (a, cut, depth + 1)]
    return out


@lru_cache(maxsize=2)
def _coder(vocabulary: str) -> Coder:
    return Coder(vocabulary)


def _vocabulary(docs: DataFrame, path: str) -> Broadcast:
    """The vocabulary file, sent to each executor once; its size does not depend on the documents."""
    with open(path, encoding="utf-8") as file:
        return docs.sparkSession.sparkContext.broadcast(file.read())


_LEAF_ROWS = "digest binary, leaf int, text string"
_PIECE_ROWS = "digest binary, leaf int, text string, ids binary"


def _cut_rows(leaf: int):
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for digest, text in zip(batch["digest"], batch["text"], strict=True):
                parts = [text[a:b] for a, b in leaves(text, leaf)]
                yield pd.DataFrame({"digest": [digest] * len(parts), "leaf": range(len(parts)), "text": parts})

    return cut


def _piece_rows(vocabulary: Broadcast):
    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = _coder(vocabulary.value)
        for batch in batches:
            yield batch.assign(ids=[np.array(coder.ids(text), coder.packed).tobytes() for text in batch["text"]])

    return encode


def _tree_rows(vocabulary: Broadcast, finish: Callable[[Coder, np.ndarray], tuple], names: list[str]):
    """Joins the leaves of each text, which come in order; holds one text at a time."""

    def text_of(rows: list) -> pd.DataFrame:
        coder = _coder(vocabulary.value)
        text = "".join(r.text for r in rows)
        at = np.cumsum([0, *[len(r.text) for r in rows]]).tolist()
        ends = list(zip(at[:-1], at[1:], strict=True))
        ids = concatenated(coder, text, [np.frombuffer(r.ids, coder.packed).astype(np.int32) for r in rows], ends)
        return pd.DataFrame([(rows[0].digest, *finish(coder, ids))], columns=["digest", *names])

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list = []
        for batch in batches:
            for row in batch.itertuples(index=False):
                if held and held[0].digest != row.digest:
                    yield text_of(held)
                    held = []
                held.append(row)
        if held:
            yield text_of(held)

    return join


def _over_texts(docs: DataFrame, path: str, text_col: str, kept: list[str], leaf: int, schema: str, short: Callable, finish: Callable) -> DataFrame:
    """The columns ``kept`` as ``_row``, beside the columns of ``schema``, which ``short`` makes of a text and ``finish`` of its ids."""
    vocabulary = _vocabulary(docs, path)
    names = [c.split()[0] for c in schema.split(", ")]

    @F.pandas_udf(schema)
    def in_place(texts: pd.Series) -> pd.DataFrame:
        coder = _coder(vocabulary.value)
        return pd.DataFrame([short(coder, t) for t in texts], columns=names)

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), whole_text(text_col).alias("_text"))
    long = F.char_length("_text") > leaf
    here = rows.filter(~long).withColumn("_code", in_place("_text")).select("_row", "_code.*")
    keyed = rows.filter(long).withColumn("digest", F.unhex(F.sha2("_text", 256)))
    # Copies of a long text are encoded once, and its leaves lie in many tasks.
    texts = keyed.groupBy("digest").agg(F.first("_text").alias("text"))
    cut = texts.mapInPandas(_cut_rows(leaf), _LEAF_ROWS).repartition("digest", "leaf")
    pieces = cut.mapInPandas(_piece_rows(vocabulary), _PIECE_ROWS)
    dealt = pieces.repartition("digest").sortWithinPartitions("digest", "leaf")
    done = stored_table(dealt.mapInPandas(_tree_rows(vocabulary, finish, names), f"digest binary, {schema}"))
    there = join_same(keyed.select("_row", "digest"), done, ["digest"], "inner").select("_row", *names)
    return here.unionByName(there)


def encoded(docs: DataFrame, path: str, text_col: str = "text", leaf: int = LEAF) -> DataFrame:
    """``docs`` with ``ids array<int>``: the tokens of each whole text in the vocabulary file at ``path``.

    As the library's ``encode(text, add_special_tokens=False).ids``; special tokens that stand in a text keep their ids. Null and
    empty texts, and texts of blanks alone, have no tokens. Copies of a row have the same tokens each. A column named ``ids`` is replaced. A very long
    text is spread over tasks by its leaves; one task holds the tokens of one text.
    """

    def short(coder: Coder, text: str) -> tuple:
        return (coder.ids(text),)

    def finish(coder: Coder, ids: np.ndarray) -> tuple:
        return (ids,)

    kept = [c for c in docs.columns if c != "ids"]
    rows = _over_texts(docs, path, text_col, kept, leaf, "ids array<int>", short, finish)
    return rows.select("_row.*", "ids")


def decoded(rows: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` with the text that the library's ``decode(ids, skip_special_tokens=False)`` gives in ``out``; null ids give an empty text."""
    vocabulary = _vocabulary(rows, path)

    @F.pandas_udf("string")
    def text_of(ids: pd.Series) -> pd.Series:
        coder = _coder(vocabulary.value)
        return pd.Series([coder.decoded(() if x is None else x) for x in ids], dtype=object)

    return rows.withColumn(out, text_of(F.col(f"`{ids_col}`")))


_DIGESTS = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF) -> DataFrame:
    """The id of each row, beside the number of its tokens, and the digests of its ids and of the decoded text.

    The same tokens as ``encoded`` and the same text as ``decoded``, hashed where they are made: ids are joined by a space.
    """

    def finish(coder: Coder, ids: np.ndarray) -> tuple:
        return len(ids), _sha256(" ".join(map(str, ids.tolist()))), _sha256(coder.decoded(ids))

    return _over_texts(docs, path, text_col, [id_col], leaf, _DIGESTS, Coder.digests, finish).select("_row.*", *[c.split()[0] for c in _DIGESTS.split(", ")])
