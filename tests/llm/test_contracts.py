"""The ten queries over whole tables of the smallest scale: their contracts' columns, and results against plain Python."""

import hashlib
import math
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from corpusloom.llm import byte_bpe, decontamination, language, line_dedup, near_dedup, neighbours, pii, quality, token_counts, toxicity

pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"


def rows(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


DOCS = {r["doc_id"]: r for r in rows("documents")}


def types(df):
    return {f.name: f.dataType.simpleString() for f in df.schema.fields}


def by_id(df):
    found = {r.doc_id: r for r in df.collect()}
    assert sorted(found) == sorted(DOCS) and df.count() == len(DOCS)
    return found


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_token_counts_and_byte_pairs(spark):
    import public_tokenizers
    import sentencepiece
    import tiktoken

    df = token_counts.op1_token_counts(spark, SF)
    assert {k: types(df)[k] for k in ("doc_id", "n_bytes", "n_tokens", "over_limit")} == {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"}
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for i, r in by_id(df).items():
        t = DOCS[i]["text"] or ""
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), len(sp.encode(t)), len(sp.encode(t)) > 4096)
    df = byte_bpe.op7_byte_bpe(spark, SF)
    assert types(df) == {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}
    tt = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    for i, r in by_id(df).items():
        t = DOCS[i]["text"] or ""
        ids = np.array(tt.encode_ordinary(t), dtype="<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


def test_decontamination(spark):
    df = decontamination.op2_decontamination(spark, SF)
    assert types(df) == {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"}
    items = [(r["item_id"], decontamination.words_of(r["text"])) for r in rows("benchmark")]
    windows = {}
    for i, w in items:
        n = min(10, len(w))
        for k in range(len(w) - n + 1) if w else ():
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    sizes = {len(w) for w in windows}
    for i, r in by_id(df).items():
        w = decontamination.words_of(DOCS[i]["text"])
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (t := tuple(w[k : k + n])) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[t]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(found), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


def test_quality_posteriors(spark):
    """Scores follow from the classifier's by the formulas of the module's text, computed over a plain dictionary of sites."""
    df = quality.op3_quality(spark, SF)
    found = by_id(df)
    odds = lambda p: math.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))
    hosts = {}
    for i, r in found.items():
        hosts.setdefault((DOCS[i]["source"] or "").lower() if DOCS[i]["source"] is not None else None, []).append(r.doc_score)
    n = {h: len(p) for h, p in hosts.items()}
    s = {h: sum(p) for h, p in hosts.items()}
    total, mean = sum(n.values()), sum(s.values()) / sum(n.values())
    within = max(0.0, sum(s[h] - s[h] ** 2 / n[h] for h in n)) / total
    between = sum(n[h] * (s[h] / n[h] - mean) ** 2 for h in n)
    spread = (between - (len(n) - 1) * within) / (total - sum(v * v for v in n.values()) / total)
    weight = min(quality.MOST_WEIGHT, max(quality.LEAST_WEIGHT, within / spread)) if spread > 0 else quality.MOST_WEIGHT
    for i, r in found.items():
        h = DOCS[i]["source"].lower() if DOCS[i]["source"] is not None else None
        site = (s[h] - r.doc_score + weight * mean) / (n[h] - 1 + weight)
        assert math.isclose(r.site_score, site, rel_tol=1e-6)
        want = 0.0 if r.doc_score == 0 else 1 / (1 + math.exp(-(odds(r.doc_score) + quality.SITE_SHARE * (odds(site) - odds(mean)))))
        assert math.isclose(r.score, want, rel_tol=1e-6, abs_tol=1e-9) and r.keep == (r.score >= quality.KEEP)


def test_quality_held_out(spark):
    from corpusloom.session import table

    sf = "/root/testdata/sf0.01"
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    docs = table(spark, sf, "documents").select("doc_id", "source", "text")
    held = "pmod(crc32(cast(cast(doc_id as string) as binary)), 5) = 0"
    out = quality.score_quality(docs, quality.learn(docs, labels.where(f"not {held}")), with_text=False).join(labels.where(held), "doc_id").where("quality is not null").collect()
    assert len(out) > 50 and sum(r.keep == bool(r.quality) for r in out) / len(out) >= 0.95


def test_neighbours(spark):
    df = neighbours.op4_neighbours(spark, SF)
    assert types(df) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"}
    v = {r["vec_id"]: np.array(r["embedding"], dtype=np.float64) for r in rows("embeddings")}
    got = {}
    for r in df.collect():
        assert math.isclose(r.score, float(np.sqrt(((v[r.query_id] - v[r.vec_id]) ** 2).sum())), rel_tol=1e-12) and r.vec_id != r.query_id
        got.setdefault(r.query_id, {})[r.rank] = (r.score, r.vec_id)
    assert sorted(got) == sorted(i for i in v if i % 100 == 0)
    hits = 0
    for q, g in got.items():
        assert sorted(g) == list(range(1, 11)) and [g[k] for k in range(1, 11)] == sorted(g.values())
        best = sorted((float(np.sqrt(((v[q] - x) ** 2).sum())), i) for i, x in v.items() if i != q)[:10]
        hits += len({i for _, i in best} & {i for _, i in g.values()})
    assert hits >= 9 * len(got)


def test_toxicity(spark):
    df = toxicity.op5_toxicity(spark, SF)
    assert {k: types(df)[k] for k in ("doc_id", "held_out", "score", "predicted")} == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    truth = {r["doc_id"]: r["toxic"] for r in rows("labels")}
    right = []
    for i, r in by_id(df).items():
        assert r.held_out == (fold(i, 5) == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
        if truth.get(i) is not None and r.held_out:
            right.append(r.predicted == truth[i])
    assert sum(right) >= 0.9 * len(right) > 0


def test_language(spark):
    df = language.op8_language_id(spark, SF)
    assert {k: types(df)[k] for k in ("doc_id", "held_out", "lang_pred", "score")} == {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"}
    texts, known = {}, {}
    for i, d in DOCS.items():
        if fold(i, 3) != 1 and d["lang"] is not None and d["text"] and language.LETTER.search(d["text"]):
            texts.setdefault(d["lang"], set()).add(d["text"])
    right = []
    for i, r in by_id(df).items():
        t, lang = DOCS[i]["text"], DOCS[i]["lang"]
        assert r.held_out == (fold(i, 3) == 1) and 0 <= r.score <= 1
        if not t or not language.LETTER.search(t):
            assert r.lang_pred == "und"
            continue
        assert r.lang_pred in texts and known.setdefault(t, (r.lang_pred, r.score)) == (r.lang_pred, r.score)
        if r.held_out and lang is not None:
            right.append(r.lang_pred == lang)
    assert sum(right) >= 0.95 * len(right) > 0


def test_language_equals_plain_compression(spark):
    """Sizes from a compressor made anew for every block, with the dictionaries that were learned."""
    import zstandard

    dictionaries = {"aa": b"lorem ipsum dolor sit amet " * 30, "bb": b"zunach gerheit ung fur das " * 30}
    texts = ["ipsum dolor", "gerheit ung " * 900, "lorem " * 500 + "fur das", "a"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in language.identify(df, dictionaries).collect():
        data = language.fold(texts[r.doc_id])
        sizes = {}
        for k, d in dictionaries.items():
            z = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            sizes[k] = sum(len(zstandard.ZstdCompressor(level=language.LEVEL, dict_data=z, write_content_size=False, write_checksum=False, write_dict_id=False).compress(data[p : p + language.BLOCK])) for p in range(0, len(data), language.BLOCK))
        assert r.lang_pred == min(sizes, key=lambda k: (sizes[k], k)) and abs(r.margin - abs(sizes["aa"] - sizes["bb"]) / min(sizes.values())) < 1e-9


def test_pii(spark):
    """What a plain scan finds is replaced, texts in which it finds nothing stay, and surrogates are one to one."""
    import regex

    plain = regex.compile(r"[\p{L}0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,24}|(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.])|AKIA[A-Z0-9]{16}|(?<![A-Za-z0-9])[a-f0-9]{32,}(?![A-Za-z0-9])|(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])")
    found = by_id(pii.op6_pii(spark, SF))
    for i, r in found.items():
        t = DOCS[i]["text"]
        if not t:
            assert r.text == t and r.n_entities == 0
            continue
        assert (r.n_entities == 0) <= (r.text == t)
        for e in plain.findall(t):
            assert e not in r.text
    assert any(r.n_entities for r in found.values())


def test_line_dedup(spark):
    found = by_id(line_dedup.op9_line_dedup(spark, SF))
    seen, dropped = {}, {}
    for i, r in found.items():
        t = DOCS[i]["text"]
        assert r.n_lines == (t.count("\n") + 1 if t else 0) and r.n_dropped == len(r.dropped)
        for k, line in line_dedup._eligible(t):
            seen.setdefault(line, []).append((i, k))
        for d in r.dropped:
            dropped[i, d.line_no] = (d.first_id, d.first_line_no)
    # Equal lines: all but the first go.
    for places in seen.values():
        assert all(p in dropped for p in sorted(places)[1:])
    # What stays for a dropped line stays, comes first, and lies in a chain of near lines with it.
    text = {(i, k): line for line, places in seen.items() for i, k in places}
    for p, first in dropped.items():
        assert first not in dropped and first < p and p in text and first in text


def test_near_dedup(spark):
    df = near_dedup.op10_near_dedup(spark, SF)
    assert types(df) == {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"}
    sets = {}
    for i, d in DOCS.items():
        w = d["text"].encode().lower().split() if d["text"] else []
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    top = {i: i for i in sets}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    where = {}
    for i, s in sets.items():
        for g in s:
            where.setdefault(g, []).append(i)
    for i, s in sets.items():
        for j in {j for g in s for j in where[g] if j > i}:
            both = len(s & sets[j])
            if 100 * both >= 85 * (len(s) + len(sets[j]) - both):
                top[max(root(i), root(j))] = min(root(i), root(j))
    for i, r in by_id(df).items():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[i]), root(i), root(i) == i)
