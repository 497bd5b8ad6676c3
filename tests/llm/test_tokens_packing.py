"""Token counts and packing, against the libraries and plain searches."""

from __future__ import annotations

import random
import zlib
from itertools import combinations

import numpy as np
from helpers import DOCS, awkward, documents, prose

from shockwatch.llm import packing, tokens
from shockwatch.llm.queries import tokenizer

BPE, PIECES = "word_bpe_49k.json", "piece_bpe_32k.model"
ODD = ["", " ", "  ", "a", " a", "a ", "  a  b\n c ", "\n\n", "x　y z\t", "<s> </s> <unk>", "é ́e",
       "don't 'S we'LL", "a,b. c,. ,d ... e.f,", "<|endoftext|> x<|startoftext|>y", "İI ΣΑΣ ς", "１２ ３x²", "word.\nNext, line",
       "\x00 nul", "\U0001f600‍\U0001f600 zwj", "the the The THE the, the."]


def test_counts_equal_the_library(spark):
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer(PIECES))
    docs = awkward(spark).unionByName(documents(spark, [(100 + i, t) for i, t in enumerate(ODD)], True))
    want = sorted((str(r.doc_id), len((r.text or "").encode()), n := len(model.encode(r.text or "")), n > 4096)
                  for r in docs.collect())
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit)
                  for r in tokens.token_counts(docs, tokenizer(PIECES)).collect()) == want
    assert any(row[3] for row in want)
    assert tokens.token_counts(spark.createDataFrame([], DOCS), tokenizer(PIECES)).count() == 0


def test_counts_without_memory_and_in_small_batches(monkeypatch):
    monkeypatch.setattr(tokens, "MEMORY", 3)
    counter = tokens.Counter(tokenizer(PIECES))
    texts = ODD + [prose(50, s) for s in range(5)]
    small = [n for batch in tokens.by_bytes(texts, 40) for n in counter.lengths(batch)]
    assert small == [len(counter.model.encode(t)) for t in texts]
    assert sorted(sum(tokens.by_bytes(texts, 40), [])) == sorted(texts)


def library_ids(text: str) -> np.ndarray:
    from tokenizers import Tokenizer
    return np.array(Tokenizer.from_file(tokenizer(BPE)).encode(text, add_special_tokens=False).ids + [1], "<u4")


def test_word_ids_equal_the_library(monkeypatch):
    words = packing.WordIds(tokenizer(BPE))
    texts = ODD + [prose(80, s) for s in range(5)]
    want = [library_ids(t)[:-1].tobytes() for t in texts]
    assert words.batch(texts) == want
    monkeypatch.setattr(packing, "MEMORY", 2)
    assert packing.WordIds(tokenizer(BPE)).batch(texts) == want


def check_packing(rows, capacity):
    used: dict[int, list] = {}
    for r in rows:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in used.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(used)


def test_pack_whole_documents(spark):
    docs = awkward(spark)
    rows = packing.pack(docs, tokenizer(BPE), 256, 1).collect()
    want = []
    for r in docs.collect():
        ids = library_ids(r.text or "")
        for piece, start in enumerate(range(0, len(ids), 256)):
            part = ids[start:start + 256]
            want.append((str(r.doc_id), piece, start, len(part), zlib.crc32(part.tobytes())))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    assert check_packing(rows, 256) <= -(-sum(w[3] for w in want) // 256) + 1
    assert packing.pack(spark.createDataFrame([], DOCS), tokenizer(BPE)).count() == 0


def optimum(items: list[int], capacity: int) -> int:
    best = len(items)

    def place(at: int, bins: list[int]) -> None:
        nonlocal best
        if len(bins) >= best:
            return
        if at == len(items):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + items[at] <= capacity and bins[k] not in bins[:k]:
                place(at + 1, bins[:k] + [bins[k] + items[at]] + bins[k + 1:])
        place(at + 1, bins + [items[at]])

    items = sorted(items, reverse=True)
    place(0, [])
    return best


def test_reduction_never_costs_a_sequence():
    """What the reduction fixes, plus an optimal packing of the rest, is an optimal packing of all."""
    rng = random.Random(1)
    for _ in range(300):
        capacity = rng.choice((10, 20, 37))
        items = [rng.randint(1, capacity) for _ in range(rng.randint(1, 9))]
        counts = {k: items.count(k) for k in items}
        held = packing.Lengths(counts)
        fixed = packing.reduce_instance(held, capacity)
        rest = [k for k, n in held.counts.items() for _ in range(n)]
        assert sum(n for _, n in fixed) + optimum(rest, capacity) == optimum(items, capacity)
        back = sorted([k for p, n in fixed for k in p * n] + rest)
        assert back == sorted(items)


def best_fit_plain(items: list[int], capacity: int) -> int:
    rooms: list[int] = []
    for length in sorted(items, reverse=True):
        fit = [r for r in rooms if r >= length]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - length)
        else:
            rooms.append(capacity - length)
    return len(rooms)


def test_grouped_best_fit_is_best_fit():
    rng = random.Random(4)
    for _ in range(200):
        capacity = rng.choice((30, 64, 100))
        items = [rng.randint(1, rng.choice((capacity, capacity // 3))) for _ in range(rng.randint(1, 80))]
        patterns = packing.best_fit(packing.Lengths({k: items.count(k) for k in items}), capacity)
        assert sorted(k for p, n in patterns for k in p * n) == sorted(items)
        assert all(sum(p) <= capacity for p, _ in patterns)
        assert sum(n for _, n in patterns) == best_fit_plain(items, capacity)


def test_plan_of_a_billion_items_is_small():
    rng = random.Random(3)
    counts = {k: rng.randint(1, 10**6) for k in range(1, 4097)}
    patterns = packing.plan(dict(counts), 4096)
    used: dict[int, int] = {}
    for p, n in patterns:
        for k in p:
            used[k] = used.get(k, 0) + n
    assert used == counts and len(patterns) < 40_000
    total = sum(k * n for k, n in counts.items())
    assert sum(n for _, n in patterns) <= total / 4096 * 1.01


def test_dominating_sets_by_definition():
    """Each set fixed beats every feasible alternative: its items can stand for theirs one by one."""
    rng = random.Random(8)
    for _ in range(400):
        capacity = rng.choice((12, 25))
        items = sorted((rng.randint(1, capacity) for _ in range(rng.randint(2, 7))), reverse=True)
        found = packing.dominating(packing.Lengths({k: items.count(k) for k in items}), items[0], capacity)
        if found is None:
            continue
        rest = items[1:]
        for n in (1, 2, 3):
            for other in combinations(rest, n):
                if sum(other) + items[0] <= capacity:
                    assert covers(found, other)


def covers(mine: tuple[int, ...], other: tuple[int, ...]) -> bool:
    """Whether ``other`` can be dealt to the items of ``mine`` without exceeding any of them."""
    if not other:
        return True
    return any(m >= other[0] and covers((*mine[:i], m - other[0], *mine[i + 1:]), other[1:]) for i, m in enumerate(mine))


def test_word_ids_outlive_a_task():
    path = tokenizer("word_bpe_49k.json")
    text = "The same words, again; the SAME words\nand 12 more."
    words = packing.word_ids(path)
    ids = words.batch([text])
    assert packing.word_ids(path) is words and words.words.keys() >= {"words,", "again;"}
    assert words.batch([text]) == ids == packing.WordIds(path).batch([text])
