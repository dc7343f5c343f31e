"""Tokenizer access inside tasks: exact ids, with a bounded table of known pieces.

Both vocabularies cut a text into pre-tokens by a fixed pattern and encode each
pre-token on its own, so the ids of a text are the ids of its pieces put end to
end, if every piece begins and ends between two pre-tokens. Pieces are found by
numpy for megabytes of text at a time: a run of letters, of digits, or of other
signs is a piece, a sign run that ends in an apostrophe goes on into the next
run (as in 's), and a space goes with what follows it where the vocabulary keeps
white space. Pieces repeat, so a chunk's pieces are looked up by 64-bit hash in a
sorted table of known ones, and the tokenizers library encodes only those not
there, many at a time. Two of TABLE pieces share a hash with a probability of
about 1e-7.

This holds for characters whose class is settled: ASCII, and the Latin letters
below U+0180. Texts with any other character go to the library whole.
``tests/llm`` compares both ways on random strings.

Control strings of the vocabulary inside a text are ordinary text
(``encode_special_tokens``), as the vocabulary's notes advise.
"""

from __future__ import annotations

import os
import re

import numpy as np

from gazette.llm.hashing import span_hashes

#: Known pieces of a worker and vocabulary, at most (about 50 MB); text bytes of a chunk.
TABLE, CHUNK = 1_500_000, 1 << 19
#: Entries of the direct-mapped table in front of it (6 MB).
SLOTS = 1 << 18
_SPACE, _LETTER, _DIGIT, _SIGN, _EDGE = range(5)
_CLASS = np.full(256, _SIGN, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = _SPACE
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 255)]] = _LETTER
_CLASS[48:58] = _DIGIT
_CLASS[255] = _EDGE
#: Both vocabularies' signs for bytes (fixed rule): printable Latin-1 characters stand for themselves, others from U+0100 on.
_SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_SIGN_OF = np.arange(256, dtype="<u4")
_SIGN_OF[[b for b in range(256) if b not in _SHOWN]] = 256 + np.arange(256 - len(_SHOWN))
#: UTF-8 bytes of anything but ASCII and Latin letters below U+0180 (which are C3 80 to C5 BF without C3 97 and C3 B7).
_OTHER = np.zeros(256, bool)
_OTHER[[0xC2, *range(0xC6, 0xFF)]] = True


class Encoder:
    """Encodes texts to little-endian uint16 ids (both vocabularies have fewer than 65,536).

    kind "word": the vocabulary ignores case and drops white space;
    kind "byte": it keeps every byte, with a space at the head of a pre-token.
    """

    def __init__(self, path: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.lib = Tokenizer.from_file(path)
        self.lib.encode_special_tokens = True
        if self.lib.get_vocab_size() > 0xFFFF:
            raise ValueError("ids must fit 16 bits")
        self.word = kind == "word"
        # new pieces go to the library joined by a mark, whose \0 has an id that
        # no piece without a \0 holds; `pad` ids of the mark stand on either side
        self.mark, self.pad = (" \x00 ", 0) if self.word else ("\n\x00\n", 1)
        ids = self._ids([f"a{self.mark}a"])[0]
        self.mark_id = ids[1 + self.pad]
        if len(ids) != 3 + 2 * self.pad:
            raise ValueError("the mark between pieces needs one id for each character")
        self.plain = re.compile(r" ?[^\s\x00-\x1f]+").fullmatch
        self._clear()

    def _clear(self) -> None:
        self.hash = np.zeros(0, np.uint64)
        self.at, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, "<u2")
        # in front of the sorted table: the last piece seen for each value of the low bits
        self.slot_hash = np.zeros(SLOTS, np.uint64)
        self.slot_at, self.slot_size = np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int64)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u2") for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_new(self, pieces: list[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sizes, ids end to end) of pieces by the library; `letters` marks runs of letters alone, with or without a space."""
        order, sizes, flat = [np.flatnonzero(letters)], [], []
        # one pre-token as it stands: only the vocabulary's merges are left to do
        raw = np.frombuffer("|".join([pieces[i] for i in order[0].tolist()]).encode(), np.uint8)
        tokenize = self.lib.model.tokenize
        for word in _SIGN_OF[raw].tobytes().decode("utf-32-le").split("|") if len(raw) else []:
            ids = [t.id for t in tokenize(word)]
            flat += ids
            sizes.append(len(ids))
        ids, rest = [np.array(flat, "<u2")], []
        plain = []
        for i in np.flatnonzero(~letters).tolist():
            (plain if self.plain(pieces[i]) else rest).append(i)
        groups = [plain[a:a + 2000] for a in range(0, len(plain), 2000)]
        for group, got in zip(groups, self._ids([self.mark.join([pieces[i] for i in g]) for g in groups])):
            at = np.flatnonzero(got == self.mark_id)
            for a, z in zip([0, *(at + 1 + self.pad).tolist()], [*(at - self.pad).tolist(), len(got)]):
                ids.append(got[a:z])
                sizes.append(z - a)
        for got in self._ids([pieces[i] for i in rest]):
            ids.append(got)
            sizes.append(len(got))
        # back from the order of encoding to that of the pieces
        flat, size = np.concatenate(ids), np.array(sizes, np.int64)
        back = np.argsort(np.concatenate([*order, np.array(plain + rest, np.int64)]), kind="stable")
        at, size = (np.cumsum(size) - size)[back], size[back]
        ends = np.cumsum(size)
        return size, flat[np.repeat(at - (ends - size), size) + np.arange(len(flat))]

    def _pieces(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last byte numbers (exclusive) of the pieces of texts that a byte 255 ends."""
        kind = _CLASS[raw]
        cut = np.empty(len(raw), bool)
        cut[0] = True
        np.not_equal(kind[1:], kind[:-1], out=cut[1:])
        after = np.flatnonzero(cut[1:] & (raw[:-1] == 0x27) & (kind[1:] != _EDGE) & (kind[1:] != _SPACE)) + 1
        cut[after] = False
        if not self.word:
            # the last of a run of white space stands alone, or goes with what follows if it is a space
            head = np.flatnonzero(cut[1:] & (kind[:-1] == _SPACE) & (kind[1:] != _EDGE)) + 1
            cut[head - 1] = True
            cut[head[raw[head - 1] == 0x20]] = False
        first = np.flatnonzero(cut)
        last = np.append(first[1:], len(raw))
        keep = kind[first] != _EDGE
        if self.word:
            keep &= kind[first] != _SPACE
        return first[keep], last[keep]

    def _places(self, joined: bytes, raw: np.ndarray, first: np.ndarray, last: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each piece's ids lie in `flat`, and how many they are; new pieces are encoded and kept."""
        known, one, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        place = np.searchsorted(self.hash, known)
        found = np.zeros(len(known), bool)
        inside = place < len(self.hash)
        found[inside] = self.hash[place[inside]] == known[inside]
        if not found.all():
            new = np.flatnonzero(~found)
            begin, end = first[one[new]], last[one[new]]
            # a run that begins with a letter has nothing else; a space may stand before it
            lead = begin + ((raw[begin] == 0x20) & (end - begin > 1))
            size, ids = self._encode_new([joined[a:z].decode() for a, z in zip(begin.tolist(), end.tolist())], _CLASS[raw[lead]] == _LETTER)
            at = len(self.flat) + np.cumsum(size) - size
            self.flat = np.concatenate([self.flat, ids])
            spot = place[new]
            self.hash, self.at, self.size = (np.insert(a, spot, b) for a, b in ((self.hash, known[new]), (self.at, at), (self.size, size)))
            place = np.searchsorted(self.hash, known)
        return self.at[place][inverse], self.size[place][inverse]

    def _chunk(self, texts: list[bytes], given: list[str]) -> list[bytes]:
        """Ids of texts by their pieces; `given` are the texts as they came."""
        joined = b"\xff".join(texts) + b"\xff"
        raw = np.frombuffer(joined, np.uint8)
        sign = (raw[1:] == 0x97) | (raw[1:] == 0xB7)
        other = np.concatenate([np.flatnonzero(_OTHER[raw]), np.flatnonzero(sign & (raw[:-1] == 0xC3))])
        if len(other):
            whole = set(np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), other, side="right").tolist())
            plain = [i for i in range(len(texts)) if i not in whole]
            rest = iter(self._chunk([texts[i] for i in plain], [given[i] for i in plain]) if plain else [])
            lib = iter(self._ids([given[i] for i in sorted(whole)]))
            return [next(lib).tobytes() if i in whole else next(rest) for i in range(len(texts))]
        first, last = self._pieces(raw)
        hashes = span_hashes(raw, first, last)
        if len(self.hash) + len(hashes) > TABLE:
            self._clear()
        slot = (hashes & np.uint64(SLOTS - 1)).astype(np.int64)
        at, size = self.slot_at[slot], self.slot_size[slot]
        missed = np.flatnonzero(self.slot_hash[slot] != hashes)
        at[missed], size[missed] = self._places(joined, raw, first[missed], last[missed], hashes[missed])
        slot = slot[missed]
        self.slot_hash[slot], self.slot_at[slot], self.slot_size[slot] = hashes[missed], at[missed], size[missed]
        ends = np.cumsum(size)
        ids = self.flat[np.repeat(at - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        stops = np.searchsorted(first, np.cumsum([len(t) + 1 for t in texts]))
        stops = np.concatenate(([0], ends))[stops].tolist()
        return [ids[2 * a:2 * z] for a, z in zip([0, *stops[:-1]], stops)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as bytes; null is an empty text."""
        texts = [t or "" for t in texts]
        raw = [(t.lower() if self.word else t).encode() for t in texts]
        out, a, held = [], 0, 0
        for z, r in enumerate(raw):
            if z > a and held + len(r) > CHUNK:
                out += self._chunk(raw[a:z], texts[a:z])
                a, held = z, 0
            held += len(r) + 1
        return out + self._chunk(raw[a:], texts[a:]) if raw else out


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, kind: str) -> Encoder:
    """The worker's encoder for a vocabulary file; kind: word or byte."""
    if (path, kind) not in _ENCODERS:
        _ENCODERS[path, kind] = Encoder(path, kind)
    return _ENCODERS[path, kind]
