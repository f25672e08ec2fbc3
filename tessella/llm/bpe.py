"""BPE encoding and decoding by prefix-sharing trie traversal.

The encoding of a word is determined by the last token of each of its prefixes: the encoding of prefix ``p`` is
the encoding of ``p`` without its last token ``t``, followed by ``t``, where ``t`` is the one suffix of ``p`` that
is compatible with the last token before it (two tokens are compatible if merging their joined symbols gives just
these two). So the distinct words of a batch go into a trie, a depth-first walk gives every node its last token,
and prefixes that words share are worked out once.
"""

from __future__ import annotations

import gc
import hashlib
import json
import struct
import unicodedata
from collections.abc import Callable

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import as_text, keeps, map_arrow

END = "</w>"
#: Words and chunks whose encodings a worker keeps in each of two generations (results don't depend on it).
KEPT_WORDS = 300_000
NEVER = 1 << 60
#: Characters that Python takes for white space and Unicode doesn't.
ODD_SPACES = regex.compile("[\x1c-\x1f]")


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where printable Latin-1, else from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Recent:
    """What was worked out lately: two generations, so that memory is bounded and frequent keys stay."""

    def __init__(self, most: int) -> None:
        self.most, self.young, self.old = most, {}, {}

    def missing(self, keys: set) -> list:
        """The keys to work out anew; every other key is in ``young`` afterwards."""
        young, old = self.young, self.old
        if len(young) + len(keys) > self.most:
            self.old, self.young = old, young = young, {}
        out = []
        for k in keys:
            if k not in young:
                if (v := old.get(k)) is not None:
                    young[k] = v
                else:
                    out.append(k)
        return out


class Codec:
    """Encodes and decodes with one tokenizer file: byte-level BPE over lower-case words with an end-of-word mark."""

    def __init__(self, content: str) -> None:
        spec = json.loads(content)
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.rank = {p: k for k, p in enumerate(pairs)}
        self.tokens = {i: t for t, i in self.vocab.items()}
        added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens |= {i: t for t, i in added.items()}
        self.added = added
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")")
        split = next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        self.bytes = byte_characters()
        self.longest = max(len(t.removesuffix(END)) for t in self.vocab)
        self.parts = {a + b: (a, b) for a, b in pairs}
        self.fits: dict[tuple[str, str], bool] = {}
        self.edges: dict[tuple[str, int], list[tuple[str, int]]] = {}
        self.words, self.chunks = Recent(KEPT_WORDS), Recent(KEPT_WORDS)

    # ---- pairs of tokens

    def symbols(self, token: str) -> list[str]:
        body = token.removesuffix(END) or token
        out = list(body)
        if body != token:
            out[-1] += END
        return out

    def merged(self, parts: list[str]) -> list[str]:
        """Applies the lowest-ranked merge, leftmost first, until none applies."""
        parts = list(parts)
        while len(parts) > 1:
            ranks = [self.rank.get(p, NEVER) for p in zip(parts, parts[1:])]
            at = min(range(len(ranks)), key=ranks.__getitem__)
            if ranks[at] == NEVER:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def edge(self, token: str, side: int) -> list[tuple[str, int]]:
        """What stands at the left (0) or right (1) end of a token while it forms, with the rank that uses it up.

        Empty for a token that its own symbols do not merge into."""
        key = (token, side)
        if (out := self.edges.get(key)) is None:
            out = []
            if self.merged(self.symbols(token)) == [token]:
                out, now = [(token, NEVER)], token
                while now in self.parts:
                    pair = self.parts[now]
                    now = pair[side]
                    out.append((now, self.rank[pair]))
                out.reverse()
            self.edges[key] = out
        return out

    def compatible(self, left: str, right: str) -> bool:
        """Whether the joined symbols of two tokens merge into just these two.

        Follows the ends that meet at the boundary as both tokens form: a merge across it happens when its rank
        comes before the ranks that use up either end (of equal ranks, the leftmost place merges first)."""
        pair = (left, right)
        if (known := self.fits.get(pair)) is None:
            if len(self.fits) > KEPT_WORDS:
                self.fits.clear()
            a, b, i, j, rank = self.edge(left, 1), self.edge(right, 0), 0, 0, self.rank
            known = bool(a and b)
            while known:
                (x, x_until), (y, y_until) = a[i], b[j]
                across = rank.get((x, y), NEVER)
                if across < x_until and across <= y_until and across != NEVER:
                    known = False
                elif x_until == NEVER and y_until == NEVER:
                    break
                elif x_until <= y_until:
                    i += 1
                else:
                    j += 1
            self.fits[pair] = known
        return known

    # ---- the trie

    def learn(self, words: list[str]) -> dict[str, tuple[bytes, bytes]]:
        """Encodes distinct words through one trie: ids as bytes and the joined tokens of each.

        The trie is kept as its words in order, in which a walk from word to word is the depth-first walk over
        nodes: the stack holds the states of the current path, a word returns to the node where it branches off
        and adds states for its own symbols only. The last symbol carries the end mark, so it is a leaf."""
        vocab, longest, fits, compatible, shown = self.vocab, self.longest, self.fits, self.compatible, self.bytes
        found: dict[str, tuple[bytes, bytes]] = {}
        # A byte's character is single, so the form's characters are the symbols; printable ASCII shows itself.
        rows = sorted((w if w.isascii() and w.isprintable() else "".join([shown[b] for b in w.encode("utf-8", "replace")]), w) for w in words)
        last: list[str] = []  # by depth: the last token of the encoding of the prefix
        back: list[int] = []  # by depth: the depth at which that token starts
        before, pack = "", struct.pack
        for form, word in rows:
            inner = len(form) - 1
            depth, most = 0, min(inner, len(last))
            while depth < most and form[depth] == before[depth]:
                depth += 1
            del last[depth:], back[depth:]
            before = form
            while depth <= inner:
                end = depth + 1
                prefix = form[:end] if depth < inner else form + END
                for start in range(max(0, end - longest), end):
                    token = prefix[start:]
                    if token in vocab:
                        if not start:
                            if self.edge(token, 1):
                                break
                        else:
                            fit = fits.get((left := last[start - 1], token))
                            if fit or fit is None and compatible(left, token):
                                break
                else:
                    raise ValueError(f"no token ends {prefix!r}")
                depth = end
                if end <= inner:
                    last.append(token)
                    back.append(start)
            tokens = [token]
            while start:
                tokens.append(last[start - 1])
                start = back[start - 1]
            tokens.reverse()
            found[word] = (pack(f"<{len(tokens)}I", *[vocab[t] for t in tokens]), " ".join(tokens).encode())
        return found

    # ---- whole texts

    def cut(self, text: str) -> list[str]:
        """Chunks that no word crosses: at white space, where Python and Unicode agree on what that is."""
        return [text] if ODD_SPACES.search(text) else text.split()

    def pieces(self, chunk: str) -> list[str]:
        """The normalised words of a chunk."""
        if not chunk.isascii():
            # Lower-casing goes by single characters: a final capital sigma becomes a plain sigma.
            chunk = unicodedata.normalize("NFC", chunk).replace("\u03a3", "\u03c3")
        return self.pattern.findall(chunk.lower())

    def encode_batch(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """Per text: ids as little-endian unsigned 32-bit integers, and the decoded text."""
        split: list[list] = []  # chunks, and special tokens (matched in the raw text) as ids
        for text in texts:
            row: list = []
            for part in self.specials.split(text) if "<|" in text else (text,):
                if part in self.added:
                    row.append(self.added[part])
                else:
                    row += self.cut(part)
            split.append(row)
        distinct: set = set()
        for row in split:
            distinct.update(row)
        fresh = self.chunks.missing(distinct)
        if fresh:
            made = {c: self.pieces(c) if c.__class__ is str else [c] for c in fresh}
            needed: set = set()
            for words in made.values():
                needed.update(words)
            learnt = self.learn([w for w in self.words.missing(needed) if w.__class__ is str])
            word = self.words.young  # which ``missing`` may have replaced
            word.update(learnt)
            for c, words in made.items():
                rows = [word[w] if w.__class__ is str else self.special(w) for w in words]
                self.chunks.young[c] = (b"".join([r[0] for r in rows]), b" ".join([r[1] for r in rows]))
        out, known = [], self.chunks.young
        for row in split:
            rows = list(map(known.__getitem__, row))
            out.append((b"".join([r[0] for r in rows]), b" ".join([r[1] for r in rows if r[1]])))
        return out

    def special(self, i: int) -> tuple[bytes, bytes]:
        return struct.pack("<I", i), self.tokens[i].encode()

    def encode(self, text: str) -> list[int]:
        ids = self.encode_batch([text])[0][0]
        return list(struct.unpack(f"<{len(ids) // 4}I", ids))

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by a space, special tokens included; ids outside the vocabulary say nothing."""
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)


_codecs: dict[str, Codec] = {}
keeps(__name__, _codecs.clear)


def codec_of(content: str) -> Codec:
    """One codec for each tokenizer and Python worker."""
    key = hashlib.sha256(content.encode()).hexdigest()
    if key not in _codecs:
        _codecs[key] = Codec(content)
    return _codecs[key]


def encode_documents(docs: DataFrame, tokenizer: str, ids: bool = True) -> DataFrame:
    """Encodes the whole ``text`` of every row with the tokenizer file at ``tokenizer`` and decodes it again.

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256 and, with ``ids``, ids (array of int). A null text counts
    as empty (no tokens); repeated rows give repeated results; other columns are ignored. The tokenizer file (a
    few MB, a fixed size) is broadcast, so executors need no path of their own.
    """
    content = docs.sparkSession.sparkContext.broadcast(open(tokenizer, encoding="utf-8").read())

    def run(batch: pa.RecordBatch) -> dict:
        gc.set_threshold(200_000, 50, 100)  # the kept words are many and hold no cycles
        texts = [as_text(b) for b in batch.column(1).to_pylist()]
        codec, rows = codec_of(content.value), []
        for at in range(0, len(texts), 200):
            rows += codec.encode_batch(texts[at : at + 200])
        out = {
            "doc_id": batch.column(0),
            "n_tokens": [len(a) // 4 for a, _ in rows],
            "ids_sha256": [hashlib.sha256(a).hexdigest() for a, _ in rows],
            "decoded_sha256": [hashlib.sha256(b).hexdigest() for _, b in rows],
        }
        return out | ({"ids": [struct.unpack(f"<{len(a) // 4}I", a) for a, _ in rows]} if ids else {})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(
        docs.select("doc_id", F.col("text").cast("binary")),
        run,
        f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids,
    )


def decode_ids(rows: DataFrame, tokenizer: str, column: str = "ids") -> DataFrame:
    """doc_id and the decoded text of each array of ids; a null array decodes to an empty text."""
    content = rows.sparkSession.sparkContext.broadcast(open(tokenizer, encoding="utf-8").read())

    def run(batch: pa.RecordBatch) -> dict:
        decode: Callable[[list[int]], str] = codec_of(content.value).decode
        return {"doc_id": batch.column(0), "text": [decode(x or []) for x in batch.column(1).to_pylist()]}

    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_arrow(rows.select("doc_id", F.col(column)), run, f"doc_id {kind}, text string")
