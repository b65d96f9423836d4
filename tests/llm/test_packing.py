import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from spark_trials.llm import packing
from spark_trials.llm.queries import tokenizer_path


def best_fit(lengths, capacity):
    """Remaining capacities after best-fit decreasing, one by one."""
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [b for b in range(len(bins)) if bins[b] >= n]
        if fits:
            at = min(fits, key=lambda b: bins[b])
            bins[at] -= n
        else:
            bins.append(capacity - n)
    return sorted(bins)


def test_plan_is_best_fit_decreasing():
    rng = random.Random(1)
    for capacity in (1, 7, 64, 100):
        for _ in range(25):
            lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 150))]
            filled, ranks = defaultdict(list), defaultdict(list)
            for length, rank, n, each, first, offset in packing.plan(Counter(lengths), capacity):
                for k in range(n):
                    ranks[length].append(rank + k)
                    filled[first + k // each].append((offset + k % each * length, length))
            assert {n: sorted(r) for n, r in ranks.items()} == {n: list(range(c)) for n, c in Counter(lengths).items()}
            left = []
            for own in filled.values():
                at = 0
                for offset, length in sorted(own):
                    assert offset == at
                    at += length
                assert at <= capacity
                left.append(capacity - at)
            assert sorted(left) == best_fit(lengths, capacity)


def test_ids_are_the_tokenizers():
    real = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["", " ", "  ", "a", " a", "a ", "Hello  world\n b", "it's 12é ok", "\u3000x \x1c y", "<|endoftext|> z", "tab\t t", "x\n\n y", "naïve über  straße", "a" * 5000, "漢字 かな", "\U0001f600 \U0001f600"]
    texts += ["hello <|endoftext|> world", "<|endoftext|><|endoftext|>", " <|endoftext|>\n", "<|endoftext|", "  <|endoftext|>  a"]
    texts += [" " * 2_000_000, "\n" * 1_200_000 + "x", "a b\t" * 3 + "\t" * 1_500_000 + " x", "a " + "\u3000" * 150_000 + "!" + " \n" * 60_000 + "<|endoftext|>" + "\x1c" * 120_000 + " z" + " " * 100_000]
    own = packing.TextCoder(tokenizer_path())
    for text in [*texts, *texts[:21]]:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == real.encode(text, add_special_tokens=False).ids


def check(rows, texts):
    real = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for doc_id, text in texts:
        ids = np.array([*real.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)] if len(ids) > 2048 else [0, len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[(doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert sorted(2048 - sum(n for _, n in own) for own in sequences.values()) == best_fit([r["length"] for r in rows], 2048)


def test_texts_of_two_megabytes(spark):
    texts = [(1, " " * 2_000_000), (2, "a" * 2_000_000), (3, "x <|endoftext|> " * 50_000)]
    check(packing.pack(spark.createDataFrame(texts, "doc_id long, text string"), tokenizer_path).collect(), texts)


def test_pack(docs, docs_rows, clashing, no_docs):
    texts = [(r[0], r[1]) for r in docs_rows]
    check(packing.pack(docs, tokenizer_path).collect(), texts)
    check(packing.pack(clashing, tokenizer_path, salt_rows=3).collect(), texts)
    assert packing.pack(no_docs, tokenizer_path).count() == 0
