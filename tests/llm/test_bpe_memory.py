"""What a worker of BPE holds at once, and that the bounds change no ids."""

import random
import subprocess
import sys
from pathlib import Path

import regex
import tiktoken

from stintline.llm import bpe

LINES, PATTERN = bpe.public_vocabulary()
LIBRARY = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe._engine(LINES).ranks, special_tokens={})

#: Six million characters of words that hardly ever come again, read as a task reads its rows; prints the MB by which the process grew.
TASK = """
import random, resource
import pyarrow as pa, regex
from stintline.llm import bpe
lines, pattern = bpe.public_vocabulary()
engine, splitter, rng = bpe._engine(lines), regex.compile(pattern), random.Random(1)
peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
def batches():
    for _ in range(6):
        texts = [" ".join("".join(rng.choices("etaoinshrdlu", k=9)) for _ in range(1000)) for _ in range(100)]
        yield pa.record_batch([pa.array(texts)], names=["text"])
before = peak()
for held in bpe._chunks(batches(), 0):
    for ids in engine.encode_ids([t for b in held for t in b.column(0).to_pylist()], splitter):
        pass
print(peak() - before)
"""


def test_memory_of_a_task_of_rare_words():
    grown = float(subprocess.run([sys.executable, "-c", TASK], capture_output=True, text=True, check=True, timeout=300, cwd=Path(__file__).parents[2]).stdout)
    assert grown < 250


def test_slices_hold_so_many_bytes_or_one_word(monkeypatch):
    monkeypatch.setattr(bpe, "REPLAY_BYTES", 100, raising=False)
    own, calls = bpe.MergeReplay(LIBRARY._mergeable_ranks), []
    replay = own.replay
    monkeypatch.setattr(own, "replay", lambda words: calls.append(words) or replay(words))
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choices("abcdefgh", k=rng.randint(3, 30))) for _ in range(40)) for _ in range(5)] + ["q" * 333, "", "short " + "zx" * 200 + " end"]
    assert list(own.encode(texts, regex.compile(PATTERN))) == [LIBRARY.encode_ordinary(t) for t in texts]
    assert len(calls) > 20 and all(len(words) == 1 or sum(map(len, words)) <= 100 for words in calls)


def test_words_that_came_again_are_remembered(monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY_BYTES", 4000)
    own, splitter = bpe.MergeReplay(LIBRARY._mergeable_ranks), regex.compile(PATTERN)
    for turn in range(6):
        texts = [f"againandagain againandagain once{turn}x{k} \ud800".encode("utf-8", "replace").decode() for k in range(20)]
        assert list(own.encode(texts, splitter)) == [LIBRARY.encode_ordinary(t) for t in texts]
        assert list(own.number.values()) == list(range(len(own.pieces))) and len(own.uses) == len(own.pieces)
        assert own.held == sum(len(w.encode()) + len(own.pieces[n]) + bpe.OVERHEAD for w, n in own.number.items())
    own.forget(4000)
    assert "againandagain" in own.number and "once5x3" not in own.number and 0 < 2 * own.held <= 4000


def test_without_decoded(spark, awkward):
    whole, ids = bpe.encode(awkward, LINES, PATTERN), bpe.encode(awkward, LINES, PATTERN, decoded=False)
    assert ids.columns == [c for c in whole.columns if c != "decoded"]
    assert sorted(map(str, ids.collect())) == sorted(map(str, whole.drop("decoded").collect()))
