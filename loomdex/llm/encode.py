"""Token ids of whole texts with a tokenizers file, each distinct chunk of a block encoded once."""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct chunks that a worker remembers between blocks; beyond it those go that didn't come again since the last time.
REMEMBERED = 900_000
#: White space other than single spaces and line ends between other characters.
_OTHER_SPACE = r"^[ \n]|[ \n]$|[ \n][ \n]|[\t\r\f\v\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Marks that a byte-level file cuts from a letter before them; only letters that every Unicode version has.
_TAILS, _TAILED = ".,", r"[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}]\%s$"
#: Bytes of text to encode at a time.
ENCODE_BYTES = 8 << 20
_encoders: dict[str, Encoder] = {}


class Encoder:
    """encode() gives what Tokenizer.encode(text, add_special_tokens=False).ids gives.

    Texts are cut into chunks at white space where the file's pre-tokenizer always cuts too, and each distinct chunk is encoded once:
    a byte-level file cuts before a space or line end that stands alone between other characters, and after such a line end; a file that drops
    white space cuts at all of it. Under a byte-level file a full stop or comma that ends a chunk after a letter is cut off too. A text with other white space, under a byte-level file, or any text under another kind of file is encoded whole.
    New chunks are encoded many to a call, apart by a mark that has one id of its own; chunks that hold the mark go alone.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        pre, norm = spec["pre_tokenizer"] or {}, spec["normalizer"]
        self.leading = pre.get("type") == "ByteLevel" and bool(pre.get("use_regex")) and not pre.get("add_prefix_space") and norm is None
        parts = pre.get("pretokenizers") or [{}]
        self.dropped = [x.get("type") for x in parts] == ["Split", "ByteLevel"] and parts[0].get("behavior") == "Removed" and parts[0].get("invert") is True and not parts[1].get("use_regex") and [x.get("type") for x in (norm or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        if any(re.search(r"\s|\x01", x["content"]) or x.get("lstrip") or x.get("rstrip") for x in spec["added_tokens"]):
            self.leading = self.dropped = False
        self.mark = "\n" if self.leading else " \x01 "
        ids = self._ids(self.mark)
        self.mark_id = ids[0] if len(ids) == 1 else None
        tails = {x: self._ids(x) for x in _TAILS if self.leading and not any(x in y["content"] for y in spec["added_tokens"])}
        self.tails = {x: ids[0] for x, ids in tails.items() if len(ids) == 1}
        self.clear()

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def clear(self) -> None:
        """Number 0 is the empty chunk, 1 the line end."""
        line = np.array(self._ids("\n"), np.uint32)
        self.known = pa.array(["", "\n"], pa.large_string())
        self.flat, self.size, self.begin = line, np.array([0, len(line)], np.int64), np.array([0, 0], np.int64)
        self.again = np.ones(2, bool)

    def _forget(self) -> None:
        keep = self.again if self.again.sum() < REMEMBERED // 2 else np.zeros(len(self.again), bool)
        keep[:2] = True
        at = np.flatnonzero(keep)
        size = self.size[at]
        ends = np.cumsum(size)
        self.flat = self.flat[np.repeat(self.begin[at] - ends + size, size) + np.arange(ends[-1])]
        self.known, self.size, self.begin = self.known.take(pa.array(at)), size, ends - size
        self.again = np.zeros(len(at), bool)

    def _encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of chunks none of which is empty."""
        inner = self.mark.strip(" ")
        alone = np.array([self.mark_id is None or inner in c for c in chunks], bool)
        sizes = np.zeros(len(chunks), np.int64)
        joined = np.flatnonzero(~alone)
        names = [chunks[j] for j in joined.tolist()] if alone.any() else chunks
        flat, where = [], []
        for k in range(0, len(joined), 2000):
            some = joined[k : k + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([self.mark.join(names[k : k + 2000])], add_special_tokens=False)[0].ids, np.uint32)
            cut = np.flatnonzero(ids == self.mark_id)
            if len(cut) != len(some) - 1:  # not to be expected; each by itself is right anyway
                alone[some] = True
                continue
            sizes[some] = np.diff(np.concatenate([[-1], cut, [len(ids)]])) - 1
            flat.append(np.delete(ids, cut))
            where.append(some)
        single = np.flatnonzero(alone)
        for j, ids in zip(single, self._whole([chunks[j] for j in single]), strict=True):
            sizes[j] = len(ids)
            flat.append(ids)
            where.append(np.array([j]))
        order = np.concatenate(where)
        flat = np.concatenate(flat)
        if (np.diff(order) > 0).all():
            return flat, sizes
        begin = np.zeros(len(chunks), np.int64)
        begin[order] = np.cumsum(sizes[order]) - sizes[order]
        ends = np.cumsum(sizes)
        return flat[np.repeat(begin - ends + sizes, sizes) + np.arange(ends[-1])], sizes

    def _numbers(self, chunks: pa.Array) -> np.ndarray:
        """Each distinct chunk's number among the remembered ones; new ones are encoded."""
        if len(self.known) > REMEMBERED:
            self._forget()
        at = pc.index_in(chunks, value_set=self.known)
        self.again[np.asarray(at.drop_null())] = True
        if at.null_count:
            gone = np.flatnonzero(np.asarray(at.is_null()))
            new = chunks.take(pa.array(gone))
            flat, size = self._encode_chunks(new.to_pylist())
            start = len(self.known)
            self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(size) - size])
            self.flat, self.size = np.concatenate([self.flat, flat]), np.concatenate([self.size, size])
            self.again = np.concatenate([self.again, np.zeros(len(new), bool)])
            self.known = pa.concat_arrays([self.known, new])
            out = np.asarray(at.fill_null(-1)).astype(np.int64)
            out[gone] = start + np.arange(len(gone))
            return out
        return np.asarray(at).astype(np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, n + 1 offsets); a null text has no ids."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        odd = np.zeros(len(texts), bool)
        if not (self.leading or self.dropped):
            odd[:] = True
        elif self.leading:
            odd = np.asarray(pc.match_substring_regex(texts, _OTHER_SPACE), bool)
        cut = pc.if_else(pa.array(odd), pa.scalar("", pa.large_string()), texts) if odd.any() else texts
        lists = pc.split_pattern(pc.replace_substring(cut, "\n", " \n "), " ") if self.leading else pc.ascii_split_whitespace(cut)
        chunks, off = lists.flatten(), np.asarray(lists.offsets).astype(np.int64)
        off = off - off[0]
        coded = chunks.dictionary_encode()
        index, names = np.asarray(coded.indices).astype(np.int64), coded.dictionary
        tail = None
        if self.leading:
            ends_with = np.full(len(names), -1, np.int64)  # the id of the mark that ends a chunk
            for x, number in self.tails.items():
                ends_with[np.asarray(pc.match_substring_regex(names, _TAILED % x), bool)] = number
            tail = ends_with[index]
            line = pc.index_in(pa.scalar("\n", pa.large_string()), value_set=names).as_py()
            head = np.zeros(len(index), bool)
            head[off[:-1]] = True
            if line is not None:  # a line end and what follows it have no space before them
                at = np.flatnonzero(index == line)
                head[at] = True
                head[at + 1] = True
            whole = names.cast(pa.large_binary())
            coded = pc.if_else(pa.array(ends_with >= 0), pc.binary_slice(whole, 0, -1), whole).cast(pa.large_string()).dictionary_encode()
            index, names = np.asarray(coded.indices).astype(np.int64)[index], coded.dictionary
            needed = np.zeros((2, len(names)), bool)
            needed[1, index[head]] = True
            needed[0, index[~head]] = True
            plain, first = np.flatnonzero(needed[0]), np.flatnonzero(needed[1])
            spaced = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), names.take(pa.array(plain)), pa.scalar(" ", pa.large_string()))
            got = self._numbers(pa.concat_arrays([spaced, names.take(pa.array(first))]))
            number = np.full((2, len(names)), -1, np.int64)
            number[0, plain], number[1, first] = got[: len(plain)], got[len(plain) :]
            which = number[head.astype(np.int64), index]
        else:
            which = self._numbers(names)[index]
        size = self.size[which]
        if tail is not None:
            size = size + (tail >= 0)
        ends = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat.take(np.arange(ends[-1]) + np.repeat(self.begin[which] - ends[:-1], size), mode="clip")
        if tail is not None:  # what was taken from behind the chunk gives way to the mark
            ids[ends[1:][tail >= 0] - 1] = tail[tail >= 0]
        starts = ends[off]
        del lists, chunks, coded, index, which
        if odd.any():
            parts = [ids[starts[k] : starts[k + 1]] for k in range(len(texts))]
            where = np.flatnonzero(odd)
            for k, x in zip(where, self._whole(texts.take(pa.array(where)).to_pylist()), strict=True):
                parts[k] = x
            ids, starts = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        return ids, starts


def encoder(path: str) -> Encoder:
    """The worker's encoder for a file; the file lies at the same path on every machine."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
