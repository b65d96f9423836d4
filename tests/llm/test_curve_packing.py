import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from spark_trials.llm import curve_packing as cp
from spark_trials.llm.queries import tokenizer_path


def check(rows, texts, capacity=2048):
    """Every id lies in one piece, sequences have no gap, and only the last tokens are not in full ones."""
    real = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    coded = [(doc_id, np.array([*real.encode(text or "", add_special_tokens=False).ids, 1], "<u4")) for doc_id, text in texts]
    sequences, pieces = defaultdict(list), defaultdict(Counter)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"], r["doc_tokens"]][r["start"], r["length"], r["ids_crc32"]] += 1
        assert r["length"] > 0
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity and (at == capacity or at & (at - 1) == 0)
    total = sum(len(ids) for _, ids in coded)
    assert sum(n for own in sequences.values() for _, n in own) == total
    assert len(sequences) == total // capacity + (total % capacity).bit_count()
    copies = defaultdict(list)
    for doc_id, ids in coded:
        copies[doc_id, len(ids)].append(ids)
    assert pieces.keys() == copies.keys()
    for key, own in copies.items():
        assert sum(n * length for (_, length, _), n in pieces[key].items()) == key[1] * len(own)
        covered = Counter()
        for (start, length, crc), n in pieces[key].items():
            assert any(zlib.crc32(ids[start : start + length].tobytes()) == crc for ids in own)
            covered.update({k: n for k in range(start, start + length)})
        assert set(covered.values()) == {len(own)}


def test_hilbert_numbers_are_a_walk_through_the_grid():
    for dimensions, bits in ((1, 4), (2, 1), (2, 5), (3, 3), (4, 3)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dimensions, indexing="ij"), axis=-1).reshape(-1, dimensions)
        numbers = cp.hilbert(grid, bits)
        assert sorted(numbers.tolist()) == list(range(len(grid)))
        assert (np.abs(np.diff(grid[np.argsort(numbers)], axis=0)).sum(axis=1) == 1).all()


def test_coordinates_against_plain_counts():
    table, rng = cp.directions(), np.random.default_rng(1)
    for n in (1, 2, 50, 3000):
        ids = rng.integers(0, 50257, n).astype("<u4")
        ids[: n // 2] = ids[0]
        counts = Counter((int(i) * 2654435769 % (1 << 32)) >> 16 for i in ids)
        want = sum(c**0.5 * table[b] for b, c in counts.items()) / n**0.5
        assert np.allclose(cp.coordinates(ids, table), want)
    assert (cp.coordinates(np.zeros(0, "<u4"), table) == 0).all()


def test_pack(docs, docs_rows, clashing, no_docs):
    texts = [(r[0], r[1]) for r in docs_rows]
    first = cp.pack_along_curve(docs, tokenizer_path).collect()
    check(first, texts)
    again = cp.pack_along_curve(clashing, tokenizer_path, sent=1).collect()
    check(again, texts)
    assert sorted(map(tuple, first), key=repr) == sorted(map(tuple, again), key=repr)
    check(cp.pack_along_curve(docs, tokenizer_path, capacity=100).collect(), texts, 100)
    assert cp.pack_along_curve(no_docs, tokenizer_path).count() == 0


def test_order_is_the_curves(spark, docs, docs_rows):
    """Documents follow each other as their numbers on the curve do, made here from all coordinates at once."""
    coded = cp.coded(docs, tokenizer_path).collect()
    points = np.array([[r[c] for c in cp.COORDINATES] for r in coded], np.float64)
    number = cp.hilbert(cp.cells(points, points.mean(axis=0), points.std(axis=0)))
    order = sorted(range(len(coded)), key=lambda k: (number[k], coded[k]["tie"]))
    want = np.repeat([coded[k]["n"] for k in order], [coded[k]["n"] for k in order])
    rows = cp.pack_along_curve(docs, tokenizer_path, with_ids=True).orderBy("sequence_id", "offset").collect()
    assert np.repeat([r["doc_tokens"] for r in rows], [r["length"] for r in rows]).tolist() == want.tolist()
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in rows)


def test_documents_alike_are_neighbours(spark):
    """Two subjects with words of their own: pieces beside each other are of one subject far more often than by chance."""
    rng = np.random.default_rng(2)
    words = [["apple", "river", "stone", "cloud", "green", "mount"], ["stock", "price", "trade", "money", "yield", "share"]]
    rows = [(k, " ".join(rng.choice(words[k % 2], 60))) for k in range(200)]
    made = cp.pack_along_curve(spark.createDataFrame(rows, "doc_id long, text string"), tokenizer_path).orderBy("sequence_id", "offset").collect()
    kinds = [r["doc_id"] % 2 for r in made]
    assert sum(a == b for a, b in zip(kinds, kinds[1:], strict=False)) > 0.9 * len(kinds)


def test_a_text_of_a_megabyte(spark):
    texts = [(1, "word " * 250_000), (2, "a" * 1_000_000), (3, None)]
    check(cp.pack_along_curve(spark.createDataFrame(texts, "doc_id long, text string"), tokenizer_path).collect(), texts)
