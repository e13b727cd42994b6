"""Alignment of two tokenizers against a computation token by token."""

from __future__ import annotations

import bisect
import hashlib
import re
from collections import Counter

import pytest
from fixtures import documents, prose

from marginalia.llm import alignment, queries

COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def options(**more):
    return alignment.AlignOptions(queries.vocabulary("byte_bpe_50k.json"), queries.vocabulary("piece_bpe_32k.model"), **more)


def _spans(ids, token_bytes):
    at, out = 0, []
    for i in ids:
        out.append((at, at + len(token_bytes(i)), i))
        at = out[-1][1]
    return out


class Plain:
    def __init__(self):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json"))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=queries.vocabulary("piece_bpe_32k.model"))
        letters = {}
        extra = 256
        for b in range(256):
            shown = 33 <= b < 127 or 161 <= b < 173 or b >= 174
            letters[chr(b if shown else extra)] = b
            extra += not shown
        self.letters = letters

    def bytes_a(self, i):
        return bytes(self.letters[c] for c in self.a.id_to_token(i))

    def bytes_b(self, i):
        piece = self.b.id_to_piece(i)
        m = re.fullmatch("<0x(..)>", piece)
        return bytes([int(m[1], 16)]) if m else piece.replace("▁", " ").encode()

    def cut(self, text):
        if not text:
            return None
        a = _spans(self.a.encode(" " + text, add_special_tokens=False).ids, self.bytes_a)
        b = _spans(self.b.encode(text), self.bytes_b)
        whole = (" " + text).encode()
        if any(b"".join(f(i) for _, _, i in side) != whole for side, f in ((a, self.bytes_a), (b, self.bytes_b))):
            return None
        return a, b


def brute(rows):
    plain = Plain()
    done, corpus = [], Counter()
    for doc_id, text in rows:
        cut = plain.cut(text)
        if cut is None:
            done.append((doc_id, None))
            continue
        a, b = cut
        links = Counter((x[2], y[2]) for x in a for y in b if x[0] < y[1] and y[0] < x[1]) if len(a) < 400 else _links(a, b)
        ends = sorted({e for _, e, _ in a} & {e for _, e, _ in b})
        groups = [([], []) for _ in ends]
        for k, side in enumerate((a, b)):
            for _, e, i in side:
                groups[bisect.bisect_left(ends, e)][k].append(str(i))
        groups = ["|".join(",".join(side) for side in group) for group in groups]
        done.append((doc_id, (len(a), len(b), len(ends), links, hashlib.sha256(";".join(groups).encode()).hexdigest())))
        corpus += links
    top = Counter()
    for (_, b), n in corpus.items():
        top[b] = max(top[b], n)
    for doc_id, found in done:
        if found is None:
            yield (doc_id, 0, 0, 0, 0, 0, 0, "")
        else:
            n_a, n_b, n_groups, links, digest = found
            best = sum(n for pair, n in links.items() if corpus[pair] == top[pair[1]])
            yield (doc_id, n_a, n_b, n_groups, sum(links.values()), best, sum(n * corpus[p] for p, n in links.items()), digest)


def _links(a, b):
    links, j = Counter(), 0
    for s, e, i in a:
        while b[j][1] <= s:
            j += 1
        k = j
        while k < len(b) and b[k][0] < e:
            links[i, b[k][2]] += 1
            k += 1
    return links


ODD = [
    "it's  two  spaces\n\n\ttabs ", "日本語 テキスト", "é ﬁ İstanbul ▁x", "<|endoftext|> <s> </s> <unk>", "á​\x00\x7f", "😀😀 x",
    " ", "\n", "x", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "\r\nwin\r\n", "12345 67.8e9", "﻿bom", "tail   ", "    head", "don't WE'LL I'd",
]


@pytest.mark.parametrize("more", [{}, {"known_pairs": 40, "partial_rows": 100}, {"known_pairs": 0}])
def test_alignment_equals_brute_force(spark, more):
    rows = [(i, t, "a", "s") for i, t in enumerate(ODD)] + [(20 + i, prose(i, 60), "a", "s") for i in range(15)]
    rows += [(50, prose(3, 60), "a", "s"), (50, prose(3, 60), "a", "s"), (None, "no id", None, None), (51, None, "a", "s"), (52, "", "a", "s")]
    docs = documents(spark, rows, extra=True)
    found = alignment.link_statistics(alignment.align(docs, options(**more)), options(**more))
    got = [tuple(r[c] for c in COLUMNS) for r in found.collect()]
    assert sorted(got, key=repr) == sorted(brute((r[0], r[1]) for r in rows), key=repr)


def test_small_slices_change_nothing(monkeypatch):
    texts = [prose(i, 40) for i in range(8)] + [None, ""] + ODD
    tools = alignment.tokenizers(options())
    whole = alignment.align_texts(texts, tools)
    for at, text in enumerate(texts):
        alone = alignment.align_texts([text], tools)
        assert [alone[c][0] for c in ("n_a", "n_b", "n_groups", "n_links")] == [whole[c][at] for c in ("n_a", "n_b", "n_groups", "n_links")]
        assert alone["groups_sha256"][0] == whole["groups_sha256"][at]
        assert dict(zip(*(alone[c][0].as_py() for c in ("pairs", "times")))) == dict(zip(*(whole[c][at].as_py() for c in ("pairs", "times"))))
        # Two partitions of the same bytes overlap once for every token, less once for every group.
        assert whole["n_links"][at] == whole["n_a"][at] + whole["n_b"][at] - whole["n_groups"][at]


def test_query_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = [tuple(r[c] for c in COLUMNS) for r in queries.op13_arrow_alignment(spark, sf_dir).collect()]
    assert sorted(got) == sorted(brute((r.doc_id, r.text) for r in docs))


def test_empty_and_long(spark):
    assert alignment.link_statistics(alignment.align(documents(spark, []), options()), options()).count() == 0
    text = prose(9, 150_000)
    (got,) = alignment.link_statistics(alignment.align(documents(spark, [(1, text, "a", "s")]), options()), options()).collect()
    assert tuple(got[c] for c in COLUMNS) == next(iter(brute([(1, text)])))
