import random

import numpy as np
import pytest

from lociweave.llm import bpe
from lociweave.llm.bpe import MergeAutomaton, word_bpe


def test_automaton_against_plain_merging():
    r = random.Random(9)
    for _ in range(30):
        labels = {c: i for i, c in enumerate("abc")}
        merges = []
        while len(merges) < 14:
            x, y = r.choice(list(labels)), r.choice(list(labels))
            if x + y not in labels and len(x + y) < 7:
                labels[x + y] = len(labels)
                merges.append((labels[x], labels[y], labels[x + y]))
        a = MergeAutomaton([0, 1, 2], merges, len(labels))
        name = {i: t for t, i in labels.items()}
        for _ in range(60):
            word = "".join(r.choice("abc") for _ in range(r.randint(1, 12)))
            toks = list(word)
            for u, v, w in merges:
                out, k = [], 0
                while k < len(toks):
                    if k + 1 < len(toks) and toks[k] == name[u] and toks[k + 1] == name[v]:
                        out.append(name[w])
                        k += 2
                    else:
                        out.append(toks[k])
                        k += 1
                toks = out
            ids = [labels[t] for t in toks]
            assert all(a.step(p, q) for p, q in zip(ids, ids[1:], strict=False))
            # No other way to cut the word is accepted.
            paths = {0: [[]]}
            for j in range(1, len(word) + 1):
                paths[j] = [p + [labels[word[i:j]]] for i in range(j) if word[i:j] in labels and a.alive[labels[word[i:j]]] for p in paths[i] if not p or a.step(p[-1], labels[word[i:j]])]
            assert paths[len(word)] == [ids]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyzeeeaaattéüßñ'’ 0123.,!?ΣσςİıǅÅé中文한국🙂👨‍👩‍👧 \t\n\x1c\x85½²Ⅷ"
    out = ["", " ", "aaaaaaaaaaaaaaaa", "<|endoftext|> hi <|startoftext|>x", "it's they'LL I'M", "e\u0301 A\u030a", "Ὀδυσσεύς ΟΔΟΣ", "x" * 3000]
    return out + ["".join(r.choice(letters) for _ in range(r.randint(0, 50))) for _ in range(1500)]


def test_equals_the_library(texts, tokenizers_dir):
    from tokenizers import Tokenizer

    path = tokenizers_dir("word_bpe_49k.json")
    lib, own = Tokenizer.from_file(path), word_bpe(path)
    for t in texts:
        want = lib.encode(t, add_special_tokens=False).ids
        got = own.encode(t)
        assert np.frombuffer(got, "<u4").tolist() == want
        assert own.decode(got) == lib.decode(want, skip_special_tokens=False)


def test_operator(spark, tokenizers_dir):
    path = tokenizers_dir("word_bpe_49k.json")
    df = spark.createDataFrame([(1, "Hello world", 5), (None, None, 6), (1, "Hello world", 5), (2, "", 7)], "doc_id long, text string, ids int")
    got = sorted((repr(r.id), len(r.ids), r.decoded) for r in bpe.encode_decode(df, path).collect())
    assert got == [("1", 8, "hello</w> world</w>"), ("1", 8, "hello</w> world</w>"), ("2", 0, ""), ("None", 0, "")]
    assert bpe.encode_decode(df.limit(0), path, digests=True).count() == 0
