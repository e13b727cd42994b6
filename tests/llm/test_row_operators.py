"""Licence scan, secret scan and packing against plain restatements of their contracts."""

from __future__ import annotations

import base64
import gzip
import re
import time
import zlib

import numpy as np
import pytest
from fixtures import documents, prose

from marginalia.llm import licenses, packing, queries, secret_scan


def _texts(spark, sf_dir):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def _license_base(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    starts, labels = [], set()
    for phrase, label in (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")):
        want = phrase.split()
        for i in range(len(words) - len(want) + 1):
            if words[i : i + len(want)] == want:
                starts.append(i)
                labels.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_license_query_equals_brute_force(spark, sf_dir):
    texts = _texts(spark, sf_dir)
    rows = queries.op2_license_scan(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == _license_base(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_license_edges(spark):
    docs = documents(spark, [
        (1, "CC-BY-NC-SA 4.0, cc by nc. Under the MIT license; under the mit licenses", "a", "s"),
        (2, None, None, None),
        (3, "SPDX-License-Identifier: GPL-3.0-or-later", "a", "s"),
        (4, "Licensed under the GNU General Public License version 2, not more", "a", "s"),
        (5, "ÄPACHE License Version 2", "a", "s"),
    ], extra=True)
    got = {r.doc_id: r for r in licenses.license_scan(docs).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (3, 0, 9, "cc-by-nc,mit")
    assert (got[2].n_words, got[2].first_word, got[2].labels, got[2].score) == (0, None, "", 0.0)
    assert got[3].labels == "gpl-3"
    assert got[4].labels == "gpl-2", "the longer signature holds the general one"
    assert got[5].n_base == 0 and got[5].base_labels == ""


def test_gates_never_hide_a_rule():
    rules = licenses.signature_rules()
    assert len(rules) > 300
    for family in licenses.FAMILIES:
        for _, _, context in licenses.CONTEXTS:
            assert re.search(r"licen|under", context)
    assert len(licenses.CLAUSES) > 100 and len({pattern for _, _, pattern in licenses.CLAUSES}) == len(licenses.CLAUSES)
    for _, keyword, pattern in licenses.STATEMENTS:
        assert any(g.decode().strip() in pattern for g in licenses.GATES) or "general public licen" in pattern, keyword


def _samples(tree) -> list[str]:
    """Matches of a parsed pattern: each alternative and each optional part, with and without."""
    out = [""]
    for op, value in tree:
        op = str(op)
        if op == "LITERAL":
            here = [chr(value)]
        elif op == "NOT_LITERAL":
            here = ["x"]
        elif op == "IN":
            here = [chr(x if str(kind) == "LITERAL" else ord("7") if str(kind) == "CATEGORY" else x[0]) for kind, x in value if str(kind) != "NEGATE"][:9]
        elif op == "BRANCH":
            here = [s for branch in value[1] for s in _samples(branch)]
        elif op == "SUBPATTERN":
            here = _samples(value[3])
        else:
            assert op in ("MAX_REPEAT", "MIN_REPEAT"), op
            here = [""] * (value[0] == 0) + _samples(value[2])
        out = [a + b for a in out for b in here]
    return out


def _matches(pattern: str) -> list[str]:
    from re import _parser

    return _samples(_parser.parse(pattern))


def test_no_keyword_hides_a_match_of_its_rule():
    rules = licenses.signature_rules()
    groups = licenses.by_keywords(rules)
    lines = [s for _, _, pattern in licenses.STATEMENTS for s in _matches(pattern)] + [phrase for phrase, _ in licenses.BASE]
    for _, _, names, _, ids in licenses.FAMILIES:
        for name in _matches(names):
            lines += [f"released under the {name}", f"the {name} license", f"license type {name}"]
        for short in _matches(ids):
            lines += [f"spdx license identifier {short}", f"opensource org licenses {short}"]
    for line in sorted({line.encode() for line in lines}):
        found = [(m.start(), m.end(), rule) for rule in rules for m in rule.pattern.finditer(line)]
        assert found and licenses.detections(line, groups) == licenses.resolve(found), line
    gaps = re.compile(r"\.\{0,\d+\}\??|\.\{1,\d+\}\??|\(\?!.*?\)")
    for _, _, pattern in licenses.CLAUSES:
        for line in {" ".join(sample.split()).encode() for sample in _matches(gaps.sub("x ", pattern))}:
            found = [(m.start(), m.end(), rule) for rule in rules for m in rule.pattern.finditer(line)]
            assert found and licenses.detections(line, groups) == licenses.resolve(found), line
    for text, label in (("released under the Expat license", "mit"), ("ASL 2.0 license", "apache-2"), ("SPDX-License-Identifier: MS-PL", "ms-pl")):
        assert [rule.label for _, _, rule in licenses.detections(b" ".join(licenses.words_of(text.encode())), groups)] == [label]


def test_resolving_equals_comparing_with_all_kept():
    rng = np.random.default_rng(0)
    rules = licenses.signature_rules()[::40]
    for _ in range(200):
        found = [(int(a), int(a + n), rules[r]) for a, n, r in zip(rng.integers(0, 60, 40), rng.integers(1, 20, 40), rng.integers(0, len(rules), 40), strict=True)]
        kept = []
        for start, end, rule in sorted(found, key=lambda d: (-d[2].priority, d[0] - d[1], d[0], d[2].label)):
            if not any(a <= start and end <= b for a, b, _ in kept):
                kept.append((start, end, rule))
        assert licenses.resolve(found) == sorted(kept, key=lambda d: (d[0], d[1], d[2].label))


def test_time_grows_with_length_not_with_detections(spark):
    phrase = "under the mit license and some words more "
    took = []
    for n in (20_000, 80_000):
        began = time.perf_counter()
        (row,) = licenses.license_scan(documents(spark, [(1, phrase * n, "a", "s")])).collect()
        took.append(time.perf_counter() - began)
        assert row.n_base == n and row.last_word == 8 * (n - 1) and len(row.detections) == n
    assert took[1] < 8 * took[0] + 2


def _secret_base(text):
    found = []
    assign = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for m in re.finditer(assign, text, re.IGNORECASE | re.ASCII):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))


def test_secret_query_equals_brute_force(spark, sf_dir):
    import hashlib

    texts = _texts(spark, sf_dir)
    for r in queries.op9_secret_scan(spark, sf_dir).collect():
        base = _secret_base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(r.spans.split(","))


def _layers(value: str) -> list[tuple[str, str]]:
    packed = base64.b64encode(value.encode()).decode()
    squeezed = base64.b64encode(gzip.compress(value.encode(), mtime=0)).decode()
    twice = base64.b64encode(packed.encode()).decode()
    return [
        ("url", "".join(f"%{b:02x}" for b in value.encode())),
        ("unicode", "".join(f"\\u{ord(c):04x}" for c in value)),
        ("unicode", "".join(f"&#{ord(c)};" for c in value)),
        ("base64", packed),
        ("base64", squeezed),
        ("base64+base64", twice),
        ("url+base64", packed.replace("=", "%3D").replace("c", "%63")),
    ]


@pytest.mark.parametrize("chain,encoded", _layers("token=Abcdef123456"))
def test_nested_layers_map_to_the_original(chain, encoded):
    text = f"é before {encoded} after"
    base, found = secret_scan.find_secrets(text)
    a, b = text.index(encoded), text.index(encoded) + len(encoded)
    inside = [s for s in found if s[2] == "assign" and a <= s[0] and s[1] <= b]
    assert not base and inside
    assert "Abcdef123456" not in secret_scan.redacted(text) and encoded not in secret_scan.redacted(text)


def _hidden() -> list[str]:
    secret = "token=Abcdef123456"
    pack = lambda raw: base64.b64encode(raw).decode()
    wrap = lambda line, n: "\n".join(line[i : i + n] for i in range(0, len(line), n))
    noise = np.random.default_rng(0).bytes(300)
    page = prose(7, 80)
    return [
        *(pack(f"prix{c} 5 {secret} fin".encode()) for c in "\u00a0\u202f\f\0"),
        pack(gzip.compress(f"prix\u00a05\0 {secret}".encode(), mtime=0)),
        pack("é è ".encode("latin-1") + secret.encode()),
        *(before + pack(secret.encode()) + after for before in ("https://h.example/cb/", "sig-", "a/", "ab_", "x") for after in ("", "/next", "-1")),
        *("sig-" + pack(squeeze(secret.encode())) for squeeze in (gzip.compress, zlib.compress)),
        *(wrap(pack(gzip.compress(noise + f" {secret} ".encode(), mtime=0)), n) for n in (64, 76, 33)),
        wrap(pack((page + secret + page).encode()), 21),
        pack(gzip.compress(b"first", mtime=0) + gzip.compress(secret.encode(), mtime=0)),
        pack(gzip.compress(secret.encode() + noise, mtime=0)[:-6]),
    ]


@pytest.mark.parametrize("encoded", _hidden())
def test_secrets_in_odd_packings_are_found(encoded):
    base, found = secret_scan.find_secrets(f"é before {encoded} after")
    assert not base and any(kind == "assign" for _, _, kind in found)
    redacted = secret_scan.redacted(f"é before {encoded} after")
    assert "[SECRET]" in redacted and not any(k == "assign" for _, _, k in secret_scan.find_secrets(redacted)[1])
    assert redacted.startswith("é before ") and redacted.endswith(" after")


def test_large_payloads_are_scanned_to_their_end(monkeypatch):
    monkeypatch.setattr(secret_scan, "MAX_UNFOLDED", 4096)
    monkeypatch.setattr(secret_scan, "OVERLAP", 256)
    for at in (100, 4085, 9000, 19_000):
        payload = prose(3, 9000).encode()[:20_000]
        payload = payload[:at] + b" token=Abcdef123456 " + payload[at:]
        packed = base64.b64encode(gzip.compress(payload, mtime=0)).decode()
        assert "[SECRET]" in secret_scan.redacted(f"sig-{packed}"), at
        text = f"see {packed}"
        assert [kind for _, _, kind in secret_scan.find_secrets(text)[1]] == ["assign"] and secret_scan.redacted(text).startswith("see [SECRET]"), at


def test_layers_that_decode_to_each_other_end():
    text = "%2525252525" * 50 + " %25%32%35"
    secret_scan.find_secrets(text)
    assert secret_scan.find_secrets("")[1] == {}


def test_secret_edges(spark):
    got = {r.doc_id: r for r in secret_scan.secret_scan(documents(spark, extra=True).where("doc_id IS NOT NULL")).collect()}
    assert got[4].spans == "" and got[5].n_hex == 0 and got[7].n_assign == 0
    docs = documents(spark, [(1, "PASSWORD: 'hunter22' x", "a", "s"), (2, None, "a", "s"), (3, "ſecret=abcdef", "a", "s")])
    clean = {r.doc_id: r for r in secret_scan.redact_secrets(docs).collect()}
    assert clean[1].text == "[SECRET]' x" and clean[1].n_chars == len(clean[1].text)
    assert clean[2].text is None and clean[3].text == "ſecret=abcdef"


def _ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.vocabulary()).encode(text, add_special_tokens=False).ids + [2]


def test_chunk_encoding_equals_the_tokenizer():
    encode = packing.ChunkEncoder(queries.vocabulary()).encode
    odd = [
        "", " ", "Hello, World.. it's ÉTÉ. don't 12x3 a_b", "a\x1cb", "été Åx", "İstanbul ΣΑΣ ﬁne", "<|endoftext|> x<|startoftext|>",
        "tab\tnew\nline nbsp　wide", "ſharp ẞ ß", "日本語 テスト.", "...,,, .x, x.,", prose(5, 300),
        "abc*** É.%%% AND.!! a$b$ x;:?, 's. a-b c/d 1a2 (x) [y]{z} #a_b `q` ~^|\\ \"w\" <a> <| x<|y", "é' ¼ ªb \x7f \x00 ñ-ñ «x» don't WE'LL ''s x'sing 'S 'x' '' ä'd 1'2 ½'t",
        "\x85a\xa0b\u2028c\u3000 d\u200be\u1680f\v\f\r\n", "".join(map(chr, range(0x21, 0x250))), " ".join(map(chr, range(0x250))),
    ]
    for text in odd:
        assert np.frombuffer(encode(text), "<u4").tolist() == _ids(text)[:-1], text


def test_merges_rebuild_every_token():
    """What the encoder of words rests on: by the merges alone, each token's bytes become that token."""
    import json

    with open(queries.vocabulary(), encoding="utf-8") as file:
        given = json.load(file)["model"]
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in given["merges"]]
    rank = {pair: i for i, pair in enumerate(merges)}
    assert [given["vocab"][a + b] for a, b in merges] == list(range(512, 512 + len(merges)))
    for token in given["vocab"]:
        if token in ("<|startoftext|>", "<|endoftext|>"):
            continue
        core = token.removesuffix("</w>")
        parts = list(core[:-1]) + [core[-1] + token[len(core) :]]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: rank.get((parts[i], parts[i + 1]), 1 << 30))
            assert (parts[best], parts[best + 1]) in rank, token
            parts[best : best + 2] = ["".join(parts[best : best + 2])]


def test_every_distinct_chunk_of_the_texts(spark, sf_dir):
    chunks = sorted(set().union(*(t.split() for t in _texts(spark, sf_dir).values())))
    encoder = packing.ChunkEncoder(queries.vocabulary())
    got = list(encoder.encode_all(chunks))
    want = encoder.tokenizer.encode_batch(chunks, add_special_tokens=False)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [w.ids for w in want]


def test_packing_query_is_an_exact_round_trip(spark, sf_dir):
    texts = _texts(spark, sf_dir)
    pieces: dict[int, list] = {}
    sequences = set()
    for r in packing.power_of_two_pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"), queries.vocabulary()).collect():
        pieces.setdefault(r.doc_id, []).append(r)
        assert r.offset == 0 and r.length & (r.length - 1) == 0 and r.length <= 4096 and 1 << r.bucket == r.length
        assert r.ids_crc32 == zlib.crc32(r.ids)
        sequences.add(r.sequence_id)
    assert sum(map(len, pieces.values())) == len(sequences)
    for doc_id, text in texts.items():
        own = sorted(pieces[doc_id], key=lambda r: r.start)
        ids = np.frombuffer(b"".join(r.ids for r in own), "<u4").tolist()
        assert ids == _ids(text) and all(r.doc_tokens == len(ids) for r in own)


def test_packing_edges(spark):
    got = packing.power_of_two_pieces(documents(spark, extra=True), queries.vocabulary(), context=16).collect()
    assert [(r.start, r.length, r.doc_tokens) for r in got if r.doc_id == 4] == [(0, 1, 1)]
    assert len({r.sequence_id for r in got}) == len(got)
    assert sum(r.length for r in got if r.doc_id == 10) == 2 * len(_ids(prose(3, 30)))
    assert packing.power_of_two_pieces(documents(spark, []), queries.vocabulary()).count() == 0
    assert packing.pieces_of(4096 + 13, 4096) == [(0, 4096), (4096, 8), (4104, 4), (4108, 1)]
