"""Huffman coding of blocks: one code per block, the tree as metadata.

The tree is built from the two lightest nodes, first left and second right; ties go to the node
with the least symbol, so equal blocks give equal bytes.  Any tree of the format is decoded.
"""

from __future__ import annotations

import heapq

import numpy as np

from satchel.functions.formats import ArchiveError

LEAF, INNER = 0x6C, 0x72  # fixed values of the serialised tree
START = 0x46
LARGE = 1 << 17  #: bits from which the larger table pays


def tree_of(counts: np.ndarray):
    """The tree as nested pairs with symbols as leaves."""
    heap = [(int(n), int(s), int(s)) for s, n in enumerate(counts) if n]
    heapq.heapify(heap)
    while len(heap) > 1:
        (n0, s0, a), (n1, s1, b) = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (n0 + n1, min(s0, s1), (a, b)))
    return heap[0][2]


def codes_of(tree) -> dict[int, str]:
    """Bits of each symbol; a lone symbol has the code 0."""
    if isinstance(tree, int):
        return {tree: "0"}
    out, todo = {}, [(tree, "")]
    while todo:
        node, bits = todo.pop()
        if isinstance(node, int):
            out[node] = bits
        else:
            todo += [(node[0], bits + "0"), (node[1], bits + "1")]
    return out


def pack_tree(tree) -> bytes:
    out, todo = bytearray([START]), [tree]
    while todo:
        node = todo.pop()
        if isinstance(node, int):
            out += bytes([LEAF, node])
        else:
            out += bytes([INNER, 0])
            todo += [node[1], node[0]]
    return bytes(out)


def unpack_tree(raw: bytes):
    if len(raw) < 3 or raw[0] != START or len(raw) % 2 == 0:
        raise ArchiveError("code tree is broken")
    open_: list[list] = []
    for k in range(1, len(raw), 2):
        if raw[k] == INNER:
            open_.append([])
            continue
        if raw[k] != LEAF:
            raise ArchiveError("code tree is broken")
        node = raw[k + 1]
        while open_:
            open_[-1].append(node)
            if len(open_[-1]) < 2:
                break
            node = tuple(open_.pop())
        else:
            if k + 2 < len(raw):
                raise ArchiveError("code tree goes on after its end")
            return node
    raise ArchiveError("code tree is cut short")


def compress(block: bytes) -> tuple[bytes, bytes]:
    """(metadata, payload) of a block that is not empty."""
    data = np.frombuffer(block, np.uint8)
    tree = tree_of(np.bincount(data, minlength=256))
    code = codes_of(tree)
    length = np.zeros(256, np.int64)
    bits = np.zeros((256, max(map(len, code.values()))), np.uint8)
    for s, c in code.items():
        length[s] = len(c)
        bits[s, : len(c)] = np.frombuffer(c.encode(), np.uint8) - 48
    parts, carry = [], np.zeros(0, np.uint8)
    for a in range(0, len(data), 1 << 18):  # whole bytes of each piece; the rest goes on
        piece = data[a : a + (1 << 18)]
        own = np.concatenate([carry, bits[piece][np.arange(bits.shape[1]) < length[piece][:, None]]])
        whole = len(own) // 8 * 8
        parts.append(np.packbits(own[:whole]).tobytes())
        carry = own[whole:]
    pad = -len(carry) % 8
    return pack_tree(tree), bytes([pad]) + b"".join(parts) + np.packbits(carry).tobytes()


def _decode_runs(raw: bytes, n_bits: int, limit: int, symbol: np.ndarray, length: np.ndarray, width: int, out: bytearray) -> int:
    """Decode with a table that gives all symbols of a window at once, up to the first code that
    is longer than the window or near the end; returns the bits used."""
    keys = np.arange(1 << width)
    used, count = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    columns, alive = [], np.ones(len(keys), bool)
    while True:
        look = (keys << used) & (len(keys) - 1)
        alive = alive & (length[look] > 0) & (used + length[look] <= width)
        if not alive.any():
            break
        columns.append(np.where(alive, symbol[look], 0).astype(np.uint8))
        count += alive
        used += np.where(alive, length[look], 0)
    flat, k = np.stack(columns, 1).tobytes(), len(columns)
    runs = [flat[i * k : i * k + c] for i, c in enumerate(count.tolist())]
    steps, mask, at = used.tolist(), len(keys) - 1, 0
    while at + 64 <= n_bits and len(out) + 64 <= limit:
        byte = at >> 3
        window = int.from_bytes(raw[byte : byte + 8], "big")
        left = start = 64 - (at & 7)
        while left >= width:
            key = window >> (left - width) & mask
            if not steps[key]:
                return at + start - left
            out += runs[key]
            left -= steps[key]
        at += start - left
    return at


def decompress(metadata: bytes, payload: bytes, most: int | None = None) -> bytes:
    """The block; at most ``most`` bytes of it."""
    if not payload:
        raise ArchiveError("payload is empty")
    if payload[0] > 7 or (payload[0] and len(payload) < 2):
        raise ArchiveError("number of padding bits is out of range")
    tree = unpack_tree(metadata)
    n_bits = 8 * (len(payload) - 1) - payload[0]
    if isinstance(tree, int):
        return bytes([tree]) * (n_bits if most is None else min(n_bits, most))
    code = codes_of(tree)
    # A table of 16 bits gives the symbols of short codes; longer ones walk the tree.
    width = min(16, max(map(len, code.values())))
    symbol, length = np.zeros(1 << width, np.int32), np.zeros(1 << width, np.int32)
    for s, c in code.items():
        if len(c) <= width:
            low = int(c, 2) << (width - len(c))
            symbol[low : low + (1 << (width - len(c)))] = s
            length[low : low + (1 << (width - len(c)))] = len(c)
    raw = payload[1:] + bytes(8)
    limit = n_bits if most is None else most
    out, at, symbols, lengths, mask = bytearray(), 0, symbol.tolist(), length.tolist(), (1 << width) - 1
    if n_bits >= LARGE:
        at = _decode_runs(raw, n_bits, limit, symbol, length, width, out)
    while at < n_bits and len(out) < limit:
        byte = at >> 3
        window = int.from_bytes(raw[byte : byte + 8], "big")
        left = 64 - (at & 7)
        start = left
        while left >= width + 8 and at < n_bits and len(out) < limit:
            key = window >> (left - width) & mask
            size = lengths[key]
            if not size:
                break
            out.append(symbols[key])
            left -= size
            at += size
        if left == start or (at < n_bits and len(out) < limit and not lengths[window >> max(left - width, 0) & mask] and left >= width):
            node = tree
            while not isinstance(node, int):
                if at >= n_bits:
                    raise ArchiveError("payload ends within a code")
                node = node[payload[1 + (at >> 3)] >> (7 - (at & 7)) & 1]
                at += 1
            out.append(node)
    if at > n_bits:
        raise ArchiveError("payload ends within a code")
    return bytes(out[:limit])
