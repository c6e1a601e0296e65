"""Whole texts to token ids with the tokenizers library, each distinct piece of text encoded once per worker."""
from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np

#: Blanks other than the space; a text with one, with a space at an end or with two in a row is split with more care.
BLANK = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u180e\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
LONE = re.compile(r"(?<=\S) (?=\S)")
#: Pieces that a worker remembers: those of late, and as many from before.
REMEMBERED = 300_000
#: Characters of texts whose new pieces are encoded together.
GROUPED = 1 << 20
#: Bytes of a column's texts whose different words are encoded together.
GROUPED_BYTES = 1 << 24
#: Stands between pieces where a tokenizer gives it one id.
MARK = "\x01"
#: Marks that may follow a word; with an apostrophe some patterns take letters too.
TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Letters that every pattern knows and that are composed already.
LETTERS = "".join(c for c in map(chr, range(0x100)) if c.isalpha() and c not in "\xaa\xb5\xba")


def spelled(chars: str) -> str:
    """chars for a regular expression of Arrow's, one by one."""
    return "".join(rf"\x{{{ord(c):x}}}" for c in chars)


#: A word of these letters, and marks behind it.
SIMPLE = rf"^[{spelled(LETTERS)}]+[{spelled(TAIL)}]*$"


def ends_word(c: str) -> bool:
    """Whether a piece that ends in c still ends in a letter when a normalizer has composed and lower-cased it."""
    return c.isalpha() and unicodedata.normalize("NFC", unicodedata.normalize("NFC", c).lower())[-1:].isalpha()


class TextEncoder:
    """encode(text) gives ids as little-endian unsigned 16-bit integers (the vocabulary must fit).

    They are the library's for add_special_tokens=False: the string of a special token in a text is that
    token.  A text that may have one is encoded whole."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size(with_added_tokens=True) > 1 << 16:
            raise ValueError("ids over 65535 don't fit")
        #: How the strings of added tokens begin, whatever their case; the rest of a text is cut into pieces.
        self.specials = sorted({t.content[:2].lower() for t in self.tokenizer.get_added_tokens_decoder().values()})
        self.remembered = remembered
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        #: A mark behind a letter is a match of its own for every pattern in use, so a word's ids go before it.
        self.tails = {c: np.asarray(self.tokenizer.encode(c, add_special_tokens=False).ids, dtype="<u2").tobytes() for c in ".,"}
        self.widths = None
        if type(self.tokenizer.pre_tokenizer).__name__ == "ByteLevel" and self.tokenizer.normalizer is None:
            self.widths = np.zeros(1 << 16, np.int64)  # a byte-level token has a character for each of its bytes
            for token, i in self.tokenizer.get_vocab().items():
                self.widths[i] = len(token)
        mark = self.tokenizer.encode(" x " + MARK + " x", add_special_tokens=False).ids
        self.mark = mark[1] if len(mark) == 3 and self.widths is None else None
        spaced = [t.ids for t in self.tokenizer.encode_batch(["ab cd", "\n ab\n\ncd "], add_special_tokens=False)]
        #: Whether blanks do nothing but separate.
        self.plain = self.mark is not None and spaced[0] == spaced[1]
        #: Whether a run of marks behind a word is a match of its own; whether upper case is lower case.
        self.apart = self.plain and self.whole("ab" + TAIL) == self.whole("ab") + self.whole(TAIL)
        self.lowers = self.plain and all(self.whole(c) == self.whole(c.lower()) for c in LETTERS)
        #: Which tokens end a match, where all that do are told by a suffix.
        self.ends = self.ending() if self.plain else None
        #: What keeps a text from being cut at spaces and line feeds alone, for Arrow; None: texts go one by one.
        self.odd = None
        if self.plain and all(s.upper() == s for s in self.specials):
            self.odd = "|".join([f"[{spelled(BLANK)}]", *map(spelled, self.specials)])

    def ending(self) -> np.ndarray | None:
        from tokenizers.pre_tokenizers import ByteLevel

        suffix, vocab = getattr(self.tokenizer.model, "end_of_word_suffix", None), self.tokenizer.get_vocab(with_added_tokens=False)
        if not suffix or "ByteLevel" not in str(self.tokenizer.pre_tokenizer) or any(c not in vocab or c + suffix not in vocab for c in ByteLevel.alphabet()):
            return None
        ends = np.zeros(1 << 16, bool)
        ends[[i for token, i in vocab.items() if token.endswith(suffix)]] = True
        return ends

    def cut(self, text: str) -> list[str]:
        """text cut at each space that stands alone between two non-blank characters; the spaces are left out.

        Byte-level pre-tokenizers put such a space at the head of the next token and never look across it, so
        the pieces' ids, each but the first with its space, are the text's ids.  Where blanks do nothing but
        separate, the text is cut at all of them."""
        blank = any(b in text for b in BLANK)
        if self.plain and not blank:
            return text.split()
        return LONE.split(text) if blank or text[:1] == " " or text[-1:] == " " or "  " in text or " \n" in text or "\n " in text else text.split(" ")

    def learn(self, new: list[str]) -> dict[str, bytes]:
        """The ids of each piece, with a space before it: all are encoded as one text.  Where a piece begins
        is told by the tokens' bytes, by a mark between pieces that has an id of its own, or by offsets."""
        if self.mark is not None:
            alone = {p: np.asarray(self.tokenizer.encode(" " + p, add_special_tokens=False).ids, dtype="<u2").tobytes() for p in new if MARK in p}
            new = [p for p in new if MARK not in p]
            if not new:
                return alone
            ids = np.asarray(self.tokenizer.encode_batch_fast([f" {MARK} ".join(new)], add_special_tokens=False)[0].ids, dtype="<u2")
            cuts = (np.flatnonzero(ids == self.mark) * 2).tolist()
            spans = map(slice, [0, *(c + 2 for c in cuts)], [*cuts, 2 * len(ids)])
            return alone | dict(zip(new, map(ids.tobytes().__getitem__, spans), strict=True))
        encode = self.tokenizer.encode_batch if self.widths is None else self.tokenizer.encode_batch_fast  # the latter has no offsets
        found = encode([" " + " ".join(new)], add_special_tokens=False)[0]
        ids = np.asarray(found.ids, dtype="<u2")
        if self.widths is not None:
            sizes, begin = [len(p.encode()) + 1 for p in new], self.widths[ids]
            begin = np.cumsum(begin) - begin
        else:
            sizes, begin = [len(p) + 1 for p in new], np.fromiter((o[0] for o in found.offsets), np.int64, len(ids))
        starts = np.cumsum(sizes) - sizes
        at = (np.searchsorted(begin, starts) * 2).tolist()
        return dict(zip(new, map(ids.tobytes().__getitem__, map(slice, at, [*at[1:], 2 * len(ids)])), strict=True))

    def remember(self, new: set[str]) -> dict[str, bytes]:
        """known, with all of the new pieces."""
        known = self.known
        if len(known) + len(new) > self.remembered:
            self.before, self.known = known, {}
            known = self.known
        known.update({p: self.before[p] for p in new if p in self.before})
        unseen = {p for p in new if p not in known}
        ended = {p: p[:-1] for p in unseen if p[-1:] in self.tails and ends_word(p[-2:-1])}
        stems = set(ended.values())
        known.update({p: self.before[p] for p in stems if p not in known and p in self.before})
        fresh = [p for p in (unseen - ended.keys()) | stems if p not in known]
        for i in range(0, len(fresh), 1000):
            known.update(self.learn(fresh[i : i + 1000]))
        known.update({p: known[stem] + self.tails[p[-1]] for p, stem in ended.items()})
        return known

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u2").tobytes()

    def encode_many(self, texts: list[str]) -> list[bytes]:
        odd = {i: self.whole(t) for i, t in enumerate(texts) if any(s in (t if s.upper() == s else t.lower()) for s in self.specials)}
        if odd:
            plain = iter(self.encode_many([t for i, t in enumerate(texts) if i not in odd])) if len(odd) < len(texts) else iter(())
            return [odd[i] if i in odd else next(plain) for i in range(len(texts))]
        parts, known = [self.cut(t) for t in texts], self.known
        if self.plain:
            found = [list(map(known.get, own)) for own in parts]
        else:
            heads = [np.asarray(x.ids, dtype="<u2").tobytes() for x in self.tokenizer.encode_batch_fast([own[0] for own in parts], add_special_tokens=False)]
            found = [[head, *map(known.get, own[1:])] for head, own in zip(heads, parts, strict=True)]
        gaps = [[i for i, ids in enumerate(got) if ids is None] if None in got else () for got in found]
        new = {own[i] for own, gap in zip(parts, gaps, strict=True) for i in gap}
        if new:
            known = self.remember(new)
            for own, got, gap in zip(parts, found, gaps, strict=True):
                for i in gap:
                    got[i] = known[own[i]]
        return [b"".join(got) for got in found]

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        """ids of each text, in order; GROUPED characters or so are looked at together."""
        group, size = [], 0
        for text in texts:
            group.append(text)
            size += len(text)
            if size >= GROUPED:
                yield from self.encode_many(group)
                group, size = [], 0
        if group:
            yield from self.encode_many(group)

    def encode_column(self, column) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For runs of texts of an Arrow column, in order: how many ids each has, and all their ids, unsigned 16-bit.

        Where blanks do nothing but separate, Arrow cuts a run into words and numbers the different ones, so
        that each is encoded once a run, and none need be remembered; a null is empty."""
        import pyarrow as pa
        import pyarrow.compute as pc

        column = pc.fill_null(column.cast(pa.string()), "")
        reach = np.cumsum(pc.binary_length(column).to_numpy()) // GROUPED_BYTES
        bounds = [0, *(np.flatnonzero(np.diff(reach)) + 1).tolist(), len(column)]
        for at, end in zip(bounds[:-1], bounds[1:], strict=True):
            texts = column.slice(at, end - at)
            if not len(texts):
                continue
            odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False) if self.odd else np.ones(len(texts), bool)
            if not odd.any():
                yield self.encode_run(texts)
                continue
            whole = self.encode_all(t for t, o in zip(texts_of(texts), odd.tolist(), strict=True) if o)
            counts, ids = self.encode_run(pc.if_else(pa.array(odd), "", texts))
            cuts = np.cumsum(counts).tolist()
            own = [next(whole) if o else ids[a:b].tobytes() for o, a, b in zip(odd.tolist(), [0, *cuts[:-1]], cuts, strict=True)]
            yield np.fromiter(map(len, own), np.int64, len(own)) // 2, np.frombuffer(b"".join(own), "<u2")

    def encode_run(self, texts) -> tuple[np.ndarray, np.ndarray]:
        import pyarrow.compute as pc

        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        ids = self.encode_pieces(words.dictionary).take(words.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int64)[: len(ids) + 1]
        return np.diff(ends[split.offsets.to_numpy()]) // 2, np.frombuffer(ids.buffers()[2] or b"", "<u2", ends[-1] // 2)

    def encode_pieces(self, pieces):
        """The ids of each piece, all different; of words with marks behind them, each word and run of marks is encoded once."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if self.ends is None or not self.apart or not self.lowers:
            return self.looked_up(pieces)
        simple = pc.match_substring_regex(pieces, SIMPLE)
        own, rest = pieces.filter(simple), pieces.filter(pc.invert(simple))
        words, tails = pc.utf8_lower(pc.utf8_rtrim(own, TAIL)).dictionary_encode(), pc.utf8_ltrim(own, LETTERS).dictionary_encode()
        behind = pa.array(map(self.whole, tails.dictionary.to_pylist()), pa.large_binary())
        ids = pc.binary_join_element_wise(self.encode_words(words.dictionary).take(words.indices), behind.take(tails.indices), pa.scalar(b"", pa.large_binary()))
        if not len(rest):
            return ids
        simple = simple.to_numpy(zero_copy_only=False)
        return pa.concat_arrays([ids, self.looked_up(rest)]).take(pa.array(np.where(simple, np.cumsum(simple) - 1, len(own) + np.cumsum(~simple) - 1)))

    def looked_up(self, pieces):
        import pyarrow as pa

        pieces = pieces.to_pylist()
        found = list(map(self.known.get, pieces))
        gaps = [i for i, ids in enumerate(found) if ids is None]
        if gaps:
            known = self.remember({pieces[i] for i in gaps})
            for i in gaps:
                found[i] = known[pieces[i]]
        return pa.array(found, pa.large_binary())

    def encode_words(self, words):
        """The ids of words of letters alone.  Each has a match at least and a match has one token that ends
        it, so as many ends as words say that each word is one match; else marks tell the words apart."""
        import pyarrow as pa
        import pyarrow.compute as pc

        bounds = [*range(0, len(words), 1000), len(words)]
        data, sizes = [], []
        for at, text in zip(bounds, pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), words), " ").to_pylist(), strict=False):
            ids = np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u2")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(own := words.slice(at, 1000)):
                data.append(ids.tobytes())
                sizes.append(np.diff(cuts, prepend=0))
            else:
                learned = self.learn(own.to_pylist())
                data += [learned[w] for w in own.to_pylist()]
                sizes.append(np.array([len(learned[w]) // 2 for w in own.to_pylist()]))
        at = np.concatenate([[0], *sizes]).cumsum().astype(np.int64) * 2
        return pa.Array.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(at), pa.py_buffer(b"".join(data))])


_encoders: dict[str, TextEncoder] = {}


#: What else a worker of this process keeps between tasks.
kept: list[dict] = [_encoders]


def release(but: dict | None = None) -> None:
    """Forgets what earlier operators keep in this worker, so that their memory doesn't add up."""
    for x in kept:
        if x is not but:
            x.clear()


def encoder(path: str, remembered: int = REMEMBERED) -> TextEncoder:
    release(_encoders)
    if path not in _encoders:
        _encoders[path] = TextEncoder(path, remembered)
    return _encoders[path]


def texts_of(column) -> Iterator[str]:
    """The texts of an Arrow column, one Python string at a time; null is empty."""
    for value in column:
        yield value.as_py() or ""
