"""Token ids by the tokenizers library, with a bounded cache of what white-space-free pieces encode to.

Neither vocabulary's pre-tokenizer lets a token span the cuts made here, so the ids of a text are the ids of its pieces in
turn: a vocabulary that drops white space is cut at ASCII white space; a byte-level one before each run of white space, which
stays with what follows it (texts with other white space are encoded whole). A piece that isn't known yet and is a run of Latin
letters, with marks after it or not, is one pre-token and a run of marks: its letters go straight to the library's BPE model.
Other pieces go through the whole library, together, kept apart by a special token. Special strings in texts stay as they are
by default.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of pieces and their ids that a worker keeps, with what Python needs for each; when full, it starts anew.
CACHE_BYTES, EACH = 80 << 20, 200
#: Pieces that are learnt at once.
LEARN = 20_000
#: Longer pieces are encoded but not kept.
KEPT_CHARS = 64
#: Characters whose pieces are held at once where Python cuts them.
HELD_CHARS = 800_000
#: ASCII white space only: other characters are white space to one library and not to the other.
_WORD = re.compile(r"[^ \t\n\r\x0b\x0c]+")
_WITH_SPACE = re.compile(r"[ \t\n\r\x0b\x0c]*[^ \t\n\r\x0b\x0c]+|[ \t\n\r\x0b\x0c]+")
_OTHER_SPACE = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Letters of Latin-1 (all in the Unicode class L, none changed by NFC), and marks that are neither letters, digits nor quotes.
_PLAIN = re.compile(r"( ?)([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,!?$%&*#|]*)")


def _byte_letters() -> dict[int, str]:
    """How a byte-level vocabulary spells the Latin-1 letters: bytes that print stand for themselves, the others follow from 256."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in prints]
    spelt = {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(others)}
    return {c: "".join(spelt[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)} | {32: spelt[32]}


_SPELT = _byte_letters()


class PieceEncoder:
    """Encodes whole texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(self.tokenizer.to_str())
        special, before = spec["added_tokens"], spec.get("pre_tokenizer") or {}
        steps = [x["type"] for x in before.get("pretokenizers", [])]
        self.spaceless = steps == ["Split", "ByteLevel"] and before["pretokenizers"][0]["invert"] and "\\s" in before["pretokenizers"][0]["pattern"].get("Regex", "")
        byte_level = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and not spec.get("normalizer")
        plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"])) for t in special)
        self.divider = special[-1] if special and plain and (self.spaceless or byte_level) else None
        self.known: dict[str, bytes] = {}
        self.bytes = 0
        self.size = self.tokenizer.get_vocab_size()
        self.raw = [i.to_bytes(4, "little") for i in range(self.size)]

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def pieces(self, text: str) -> list[str]:
        if self.spaceless:
            return _WORD.findall(text)
        if not text.isascii() and any(c in text for c in _OTHER_SPACE):
            return [text]
        return _WITH_SPACE.findall(text)

    def _learn(self, new: list[str]) -> None:
        now, tokenize, rest = self.known, self.tokenizer.model.tokenize, []
        plain: list[tuple[str, str, str]] = []
        for piece in new:
            if piece.isascii() and piece.isalpha():
                stem = piece.lower() if self.spaceless else piece
                ids = now.get(stem)
                if ids is None:
                    ids = now[stem] = b"".join([self.raw[t.id] for t in tokenize(stem)])
                now[piece] = ids
                continue
            m = _PLAIN.fullmatch(piece)
            if m is None:
                rest.append(piece)
                continue
            stem = (m[2].lower() if self.spaceless else m[1] + m[2]) if m[3] or self.spaceless else piece
            if stem not in now:
                spelt = stem if stem[0] != " " and stem.isascii() else stem.translate(_SPELT)
                now[stem] = b"".join([self.raw[t.id] for t in tokenize(spelt)])
            if m[3]:
                if m[3] not in now:
                    now[m[3]] = self._whole(m[3])
                plain.append((piece, stem, m[3]))
            elif stem != piece:
                now[piece] = now[stem]
        for piece, stem, marks in plain:
            now[piece] = now[stem] + now[marks]
        mark, mark_id = self.divider["content"], self.divider["id"]
        short = [x for x in rest if mark not in x]
        for x in rest:
            if mark in x:
                now[x] = self._whole(x)
        if short:
            ids = np.array(self.tokenizer.encode(mark.join(short), add_special_tokens=False).ids, dtype="<u4")
            raw, start = ids.tobytes(), 0
            ends = [*np.flatnonzero(ids == mark_id).tolist(), len(ids)]
            if len(ends) != len(short):
                raise ValueError("the divider did not keep the pieces apart")
            for piece, end in zip(short, ends, strict=True):
                now[piece] = raw[4 * start : 4 * end]
                start = end + 1

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as bytes."""
        if self.divider is None:
            return [self._whole(t) for t in texts]
        collects = gc.isenabled()
        gc.disable()  # nothing here is cyclic, and each collection would visit all pieces
        try:
            return self._encode(texts)
        finally:
            if collects:
                gc.enable()

    def _ids(self, pieces: list[str]) -> list[bytes]:
        """The ids of distinct pieces."""
        own = list(map(self.known.get, pieces))
        new = [i for i, ids in enumerate(own) if ids is None]
        for at in range(0, len(new), LEARN):
            if self.bytes > CACHE_BYTES:
                self.known, self.bytes = {}, 0
            some, before = new[at : at + LEARN], len(self.known)
            self._learn([pieces[i] for i in some])
            for i in some:
                own[i] = ids = self.known[pieces[i]]
                if len(pieces[i]) > KEPT_CHARS:
                    del self.known[pieces[i]]
                else:
                    self.bytes += len(pieces[i]) + len(ids)
            self.bytes += EACH * max(0, len(self.known) - before)
        return own

    def _encode(self, texts: list[str]) -> list[bytes]:
        if self.spaceless:
            return self._encode_words(pa.array(texts, pa.string()))
        if len(texts) > 1 and sum(map(len, texts)) > HELD_CHARS:
            return self._encode(texts[: len(texts) // 2]) + self._encode(texts[len(texts) // 2 :])
        cut = [self.pieces(t) for t in texts]
        distinct = list(set().union(*cut))  # few, and so faster than a lookup of each occurrence
        get = dict(zip(distinct, self._ids(distinct), strict=True)).__getitem__
        return [b"".join(map(get, pieces)) for pieces in cut]

    def _encode_words(self, texts: pa.Array) -> list[bytes]:
        """The same for pieces between white space, which Arrow cuts and numbers."""
        lists = pc.ascii_split_whitespace(texts)
        numbered = lists.values.dictionary_encode()
        distinct = numbered.dictionary
        whole = pa.ListArray.from_arrays(pa.array([0, len(distinct)], pa.int32()), distinct)
        coded = self._ids(pc.binary_join(whole, "\n")[0].as_py().split("\n")) if len(distinct) else []  # no piece has a line end
        sizes = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        flat, at = np.frombuffer(b"".join(coded), "<u4"), np.cumsum(sizes) - sizes
        which = numbered.indices.to_numpy()
        counts = sizes[which]
        ends = np.concatenate([[0], np.cumsum(counts)])
        ids = flat[np.repeat(at[which] - ends[:-1], counts) + np.arange(ends[-1])]
        cuts = ends[lists.offsets.to_numpy()].tolist()
        return [ids[i:j].tobytes() for i, j in zip(cuts, cuts[1:], strict=False)]


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One for each worker process and vocabulary."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def in_slices(texts: list[str], chars: int = 1_000_000):
    """Index ranges of texts that together have about so many characters."""
    start = total = 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= chars:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def version_digest(path: str) -> str:
    """Hex SHA-256 of a vocabulary file and the library's version."""
    import tokenizers

    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + tokenizers.__version__.encode()).hexdigest()
