"""Plain single-process versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import public_tokenizers
import xxhash
from tokenizers import Tokenizer

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def exact_groups(rows: list[tuple]) -> dict:
    """(id, text) rows -> text -> (keep_id, group_size)."""
    groups: dict[str, list] = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(UPPER), []).append(i)
    return {t: (max(x for x in ids if x is not None) if any(x is not None for x in ids) else None, len(ids)) for t, ids in groups.items()}


def fingerprint(text: str | None) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    if not words:
        return 0
    k = min(4, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_components(rows: list[tuple]) -> dict:
    """(id, text) rows -> id -> (fingerprint, component)."""
    fps = {i: fingerprint(t) for i, t in rows}
    kinds = sorted(set(fps.values()))
    root = {f: f for f in kinds}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a, f in enumerate(kinds):
        for g in kinds[:a]:
            if (f ^ g).bit_count() <= 4:
                root[find(f)] = find(g)
    least: dict[int, int] = {}
    for i, f in fps.items():
        least[find(f)] = min(i, least.get(find(f), i))
    return {i: (f"{f:016x}", least[find(f)]) for i, f in fps.items()}


def without_repeats(texts: list[str | None], window: int = 200) -> list[tuple[int, int, int, bytes]]:
    """n_bytes, n_removed, n_spans and the remaining bytes of each text."""
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + window] for r in raws for i in range(len(r) - window + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - window + 1):
            if seen[r[i : i + window]] > 1:
                gone[i : i + window] = b"\x01" * window
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        out.append((len(r), len(r) - len(kept), len(re.findall(b"\x01+", bytes(gone))), kept))
    return out


def digest(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()


def pieces(text: str | None, limit: int = 1024) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a document."""
    ids = [*_tokenizer("byte_bpe_50k.json").encode(text or "", add_special_tokens=False).ids, 2]
    first = len(ids) % limit if len(ids) > limit else len(ids)
    stops = ([first] if first else []) + list(range(first + limit, len(ids) + 1, limit))
    out, begin = [], 0
    for k, stop in enumerate(stops):
        out.append((k, begin, stop - begin, zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[begin:stop]))))
        begin = stop
    return out


_held: dict = {}


def _tokenizer(name: str) -> Tokenizer:
    if name not in _held:
        _held[name] = Tokenizer.from_file(public_tokenizers.path(name))
    return _held[name]


def library_count(text: str | None) -> int:
    return len(_tokenizer("word_bpe_49k.json").encode(text or "", add_special_tokens=False).ids)
