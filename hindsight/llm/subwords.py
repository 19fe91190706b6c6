"""Subword ids of whole texts, by a public tokenizer file whose path is a parameter."""

from functools import cache
from typing import NamedTuple
from unicodedata import normalize

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: Bytes of words and their ids that a Python worker keeps, its objects' own size included.
KEPT_BYTES = 80_000_000
_OBJECTS = 200
#: ASCII punctuation but the apostrophe, which tokenizers join with letters.
_TAIL = bytes(range(33, 39)) + bytes(range(40, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127))
#: Words that go through the tokenizer together.
_GROUP = 1000
#: A private-use character: between words it tells their ids apart.
_BETWEEN = "\ue000"


def _letters(word: bytes) -> bool:
    """Whether the word is letters only and stays so in lower case, which puts a mark after some."""
    if word.isascii():
        return word.isalpha()
    text = word.decode()
    return text.isalpha() and normalize("NFC", text).lower().isalpha()


#: Letters that stay single letters whatever is done to them, so that no more than a look is needed.
_PLAIN_LETTERS = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+$"


def strings(array: pa.Array) -> list[bytes]:
    """The strings of an array without nulls. ``to_pylist`` takes several times as long."""
    if not len(array):
        return []
    ends = np.frombuffer(array.buffers()[1], np.int32)[array.offset : array.offset + len(array) + 1].tolist()
    raw = (array.buffers()[2] or pa.py_buffer(b"")).to_pybytes()
    return [raw[low:high] for low, high in zip(ends, ends[1:], strict=False)]


class Words(NamedTuple):
    """The words of some texts: ``numbers[offsets[i] : offsets[i + 1]]`` are text i's in ``distinct``, which
    may hold an empty string that no number stands for."""

    offsets: np.ndarray
    numbers: np.ndarray
    distinct: pa.Array


class Encoder:
    """Ids as little-endian bytes, two or four per id as the vocabulary needs.

    For tokenizers that drop white space and so never join what it separates, a text's ids are those
    of its words, one after the other. Words recur, so their ids are kept, as many as ``KEPT_BYTES`` hold. Of a
    tokenizer that also cuts words between letters and the punctuation after them, which is tried out for each
    mark, letters are encoded once for all endings. ``by_word=False`` encodes whole texts, for tokenizers of
    other kinds.
    """

    def __init__(self, path: str, by_word: bool = True):
        self.tokenizer = Tokenizer.from_file(path)
        self.by_word = by_word
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[bytes, bytes] = {}
        self.kept = 0
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        #: Whether an id ends a word, where the vocabulary tells.
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        if suffix:
            self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(suffix)]] = True
        marks = [bytes([mark]).decode() for mark in _TAIL]
        heads = ["b", "\u00e9"]
        tried = self._encoded([*heads, *marks, *[head + mark for head in heads for mark in marks]])
        alone, together = tried[: len(heads) + len(marks)], tried[len(heads) + len(marks) :]
        self.cuts = together == [alone[h] + alone[len(heads) + m] for h in range(len(heads)) for m in range(len(marks))]
        self.between = np.frombuffer(self._encoded([_BETWEEN])[0], self.dtype)

    def _encoded(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, self.dtype).tobytes() for x in found]

    def _parts(self, some: pa.Array) -> pa.Array:
        """Ids of words without parts. What is encoded is kept for later texts: frequent words come early, so
        the first to come stay."""
        coded = some.dictionary_encode()
        parts = strings(coded.dictionary)
        found = list(map(self.known.get, parts))
        missing = [i for i, ids in enumerate(found) if ids is None]
        letters = [i for i in missing if _letters(parts[i])]
        marked = sorted(set(missing).difference(letters))
        for kind, encode in ((letters, self._encoded_letters), (marked, self._encoded_marked)):
            for i, ids in zip(kind, encode([parts[i] for i in kind]), strict=True):
                found[i] = ids
                size = _OBJECTS + len(parts[i]) + len(ids)
                if self.kept + size <= KEPT_BYTES:
                    self.known[parts[i]] = ids
                    self.kept += size
        return pa.array(found, pa.binary()).take(coded.indices)

    def _encoded_words(self, some: pa.Array) -> pa.Array:
        """Ids of distinct words. Where the tokenizer cuts between letters and the punctuation after them, words
        that end so are put together from both parts."""
        if not self.cuts:
            return self._parts(some.cast(pa.binary()))
        stems = pc.ascii_rtrim(some, characters=_TAIL.decode())
        cut = pc.match_substring_regex(stems, _PLAIN_LETTERS).to_numpy(zero_copy_only=False).copy()
        wide = np.flatnonzero(~(cut | pc.string_is_ascii(stems).to_numpy(zero_copy_only=False)))
        cut[wide] = [_letters(stem) for stem in strings(stems.take(pa.array(wide)))]
        sizes, lengths = (pc.binary_length(x).to_numpy() for x in (stems, some))
        ended = np.flatnonzero(cut & (sizes < lengths))
        heads = self._parts(pc.if_else(pa.array(cut), stems, some).cast(pa.binary()))
        whole = strings(some.take(pa.array(ended)))
        tails = self._parts(pa.array([word[n:] for word, n in zip(whole, sizes[ended].tolist(), strict=True)], pa.binary()))
        at = np.full(len(some), -1)
        at[ended] = np.arange(len(ended))
        tails = pc.fill_null(tails.take(pa.array(at, mask=at < 0)), b"")
        return pc.binary_join_element_wise(heads, tails, b"")

    def _encoded_letters(self, some: list[bytes]) -> list[bytes]:
        """Ids of words of nothing but letters. Where ids tell the ends of words, nothing need stand between them."""
        out = []
        for low in range(0, len(some), _GROUP):
            group = some[low : low + _GROUP]
            found = self.tokenizer.encode_batch_fast([b" ".join(group).decode()], add_special_tokens=False)
            ids = np.array(found[0].ids, self.dtype)
            ends = ((np.flatnonzero(self.ends[ids]) + 1) * self.dtype.itemsize).tolist()
            raw = ids.tobytes()
            if len(ends) == len(group) and ends[-1] == len(raw):
                out += [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]
            else:
                out += self._encoded_marked(group)
        return out

    def _encoded_marked(self, some: list[bytes]) -> list[bytes]:
        """Ids of each word. Words go through the tokenizer together with a mark between them."""
        if not len(self.between) or any(_BETWEEN.encode() in word for word in some):
            return self._encoded([word.decode() for word in some])
        out, mark = [], f" {_BETWEEN} "
        for low in range(0, len(some), _GROUP):
            group = some[low : low + _GROUP]
            ids = self.tokenizer.encode_batch_fast([b" ".join(group).decode().replace(" ", mark)], add_special_tokens=False)
            ids = np.array(ids[0].ids, self.dtype)
            n = len(self.between)
            at = np.ones(max(0, len(ids) - n + 1), bool)
            for i, value in enumerate(self.between):
                at &= ids[i : len(ids) - n + 1 + i] == value
            cuts = np.flatnonzero(at)
            if len(cuts) != len(group) - 1:
                raise ValueError("the tokenizer joins what white space separates; use by_word=False")
            raw, width = ids.tobytes(), self.dtype.itemsize
            starts, ends = [0, *((cuts + n) * width).tolist()], [*(cuts * width).tolist(), len(raw)]
            out += [raw[a:b] for a, b in zip(starts, ends, strict=True)]
        return out

    def split(self, texts: pa.Array, lower: bool = False) -> Words:
        """The texts' words. Capitals go if told so or where the tokenizer lowers them anyway, for more recurrence,
        unless that could make the text spell a special token. Arrow's ASCII white space is that of ``bytes.split``."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if lower or self.lowers:
            small = pc.ascii_lower(texts)
            marked = [pc.match_substring(texts, mark).to_numpy(zero_copy_only=False) for mark in {m[:2].decode() for m in self.special}]
            marked = np.any([np.zeros(len(texts), bool), *marked], axis=0)
            texts = pc.if_else(pa.array(marked), texts, small) if marked.any() else small
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        offsets, numbers = lists.offsets.to_numpy(), coded.indices.to_numpy()
        # White space at either end, and a text without words, give empty strings.
        empty = pc.index(coded.dictionary, "").as_py()
        if empty >= 0:
            filled = numbers != empty
            offsets = np.concatenate([[0], np.cumsum(filled)])[offsets]
            numbers = numbers[filled]
        return Words(offsets, numbers, coded.dictionary)

    @property
    def lowers(self) -> bool:
        return self.__dict__.setdefault("_lowers", self._encoded(["QX"]) == self._encoded(["qx"]))

    def ids(self, texts: list[str | None]) -> list[bytes]:
        data = [None if text is None else text.encode("utf-8", "replace") for text in texts]
        return self.ids_of(pa.array(data, pa.binary()).cast(pa.string())).to_pylist()

    def ids_of(self, texts: pa.Array) -> pa.Array:
        """The same for an Arrow array of texts."""
        if not self.by_word:
            return pa.array(self._encoded([text or "" for text in texts.to_pylist()]), pa.binary())
        return self.ids_of_words(self.split(texts))

    def ids_of_words(self, words: Words) -> pa.Array:
        """Ids of texts that are split into words already: those of the words end to end, cut by text."""
        flat = self._encoded_words(words.distinct).take(pa.array(words.numbers))
        ends = np.frombuffer(flat.buffers()[1], np.int32, len(flat) + 1)[words.offsets] if len(flat) else np.zeros(len(words.offsets), np.int32)
        return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), flat.buffers()[2] or pa.py_buffer(b"")])


@cache
def encoder(path: str, by_word: bool = True) -> Encoder:
    """The worker's encoder for a file."""
    return Encoder(path, by_word)
