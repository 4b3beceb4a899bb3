"""The operators of the subpackage against brute force, libraries and round trips, with odd inputs."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from bytelode.llm import chat, decontaminate, embeddings, piece_transducer, queries, simhash, token_store, tokens, toxicity, url_filter, warc  # noqa: E402
from bytelode.llm.components import connected_components  # noqa: E402
from bytelode.llm.perfect_hash import PerfectHash, mix  # noqa: E402

SF = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
LONG = " ".join(f"word{i % 977} tail{i % 13}" for i in range(60_000))
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, n_tokens int, hits int, fp string, component_id string, file string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, "x", 2, 3, "y", "z", "f") for i, t in rows], DOCS)


ODD = [(1, "one two three four"), (2, None), (3, ""), (4, "   \n\t "), (5, LONG), (6, LONG), (7, "One TWO three four"), (7, "One TWO three four"), (None, "nobody's text"), (9, "\x00 é́ <|endoftext|> 中文 ▁ \u2028 x"), (10, "a  b\n \nc   \t d ")]


def components(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def test_components_match_union_find(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(90), rng.randrange(90)) for _ in range(60)] + [(7, 7)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = components({x for e in edges for x in e}, edges)
    assert got == {n: r for n, r in want.items() if n != r}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def simhash_groups(rows):
    fps = [(i, simhash.fingerprint(t)) for i, t in rows]
    distinct = sorted({f for _, f in fps})
    of = components(distinct, [(a, b) for k, a in enumerate(distinct) for b in distinct[k + 1 :] if (a ^ b).bit_count() <= 2])
    least = defaultdict(lambda: None)
    for i, f in fps:
        if i is not None and (least[of[f]] is None or i < least[of[f]]):
            least[of[f]] = i
    return sorted((str(i), f"{f:016x}", str(least[of[f]])) for i, f in fps)


def naive_fingerprint(text):
    import re

    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_on_odd_rows_and_real_ones(spark):
    rows = ODD + [(r.doc_id + 100, r.text) for r in queries.table(spark, SF, "documents").collect()]
    assert all(simhash.fingerprint(t) == naive_fingerprint(t) for _, t in rows)
    got = simhash.near_duplicates(docs(spark, rows)).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")), "component_id").collect()
    assert sorted(tuple(map(str, r)) for r in got) == simhash_groups(rows)
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


@pytest.mark.parametrize("bucket", [256, 8])
def test_simhash_links_are_complete_in_full_buckets(spark, bucket):
    rng = random.Random(3)
    values = set()
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(25):
            x = base
            for b in rng.sample(range(64), rng.randrange(4)):
                x ^= 1 << b
            values.add(x)
    fps = spark.createDataFrame([(v - (1 << 64) * (v >> 63),) for v in values], "fp long")
    edges = [(r.u, r.v) for r in simhash.near_links(fps, bucket=bucket).collect()]
    assert all(((u ^ v) & (1 << 64) - 1).bit_count() <= 2 for u, v in edges)
    nodes = [v - (1 << 64) * (v >> 63) for v in values]
    true = [(a, b) for a in nodes for b in nodes if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2]
    assert components(nodes, edges) == components(nodes, true)


def test_drop_near_duplicates_keeps_one_and_all_columns(spark):
    kept = simhash.drop_near_duplicates(docs(spark, ODD))
    assert kept.columns == docs(spark, []).columns
    ids = sorted(str(r.doc_id) for r in kept.collect())
    assert ids == ["1", "10", "2", "5", "9", "None"]


def test_near_duplicates_are_dropped_by_row_not_by_id(spark):
    rows = [(1, "one two three four"), (2, "alpha beta gamma delta epsilon"), (2, "one two three four"), (3, "zeta eta theta iota"), (3, "kappa lambda mu nu xi"), (3, "kappa lambda mu nu xi"), (None, "one two three four"), (None, "only here and nowhere else"), (None, "ONE two three four")]
    kept = sorted((str(r.doc_id), r.text) for r in simhash.drop_near_duplicates(docs(spark, rows)).collect())
    assert kept == sorted([("1", "one two three four"), ("2", "alpha beta gamma delta epsilon"), ("3", "zeta eta theta iota"), ("3", "kappa lambda mu nu xi"), ("None", "only here and nowhere else")])
    same_id = [(5, "one two three four", "b"), (5, "One two three four", "a"), (6, "one two three four", "a")]
    assert simhash.drop_near_duplicates(spark.createDataFrame(same_id, "doc_id long, text string, lang string")).count() == 1
    with_map = spark.createDataFrame([(1, "a b c", {"k": 1}), (2, "a b c", {"k": 2})], "doc_id long, text string, n_rows map<string,int>")
    assert [r.doc_id for r in simhash.drop_near_duplicates(with_map).collect()] == [1]
    assert simhash.drop_near_duplicates(docs(spark, [])).count() == 0


def test_fingerprints_of_long_texts_taken_in_blocks(monkeypatch):
    monkeypatch.setattr(simhash, "_WHOLE", 100)
    assert simhash.fingerprint(LONG + " " + LONG) == naive_fingerprint(LONG + " " + LONG)
    assert simhash.fingerprint(" a" * 30 + " " * 100) == naive_fingerprint(" a" * 30 + " " * 100)


def test_token_counts_and_store_match_the_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    rng = random.Random(2)
    alphabet = [" ", "  ", "\n", "\t", "the", "Ünï", "'s", "12", "!", "<|endoftext|>", "\u3000", "\x1c", "\x85", "ß", "中", "x" * 50, "\u200b"]
    rows = ODD + [(100 + k, "".join(rng.choices(alphabet, k=rng.randrange(12)))) for k in range(1500)] + [(5000 + r.doc_id, r.text) for r in queries.table(spark, SF, "documents").collect()]
    ids = {text: t.encode(text or "", add_special_tokens=False).ids for _, text in rows}
    got = tokens.count_tokens(docs(spark, rows), BPE).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == sorted((str(i), len((x or "").encode()), len(ids[x]), len(ids[x]) > 1024) for i, x in rows)

    stored = token_store.stored_documents(token_store.write_store(docs(spark, rows), BPE)).collect()
    start, want = 0, []
    for i, x in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        data = np.array([*ids[x], 0], dtype="<u4")
        want.append((str(i), start, len(data), zlib.crc32(data.tobytes())))
        start += len(data)
    assert sorted((str(r.doc_id), r.start, r.n_tokens, r.ids_crc32) for r in stored) == sorted(want)
    assert token_store.stored_documents(token_store.write_store(docs(spark, []), BPE)).count() == 0


def test_whole_tokens_are_proven():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    with open(BPE, encoding="utf-8") as f:
        whole = tokens.prove_whole(f.read())
    assert len(whole) > 40_000
    assert all(len(t.encode(s).ids) == 1 for s in random.Random(1).sample(sorted(whole), 500))


def test_absent_keys_are_not_found(spark):
    manifest = token_store.write_store(docs(spark, ODD), BPE)
    some = manifest.select("shard").limit(1)
    absent = some.crossJoin(spark.range(1000, 3000).select(F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("copy")))
    assert token_store.read_keys(absent.select("shard", "doc_id", "copy")).count() <= 1  # a 32-bit fingerprint may agree


def test_perfect_hash_is_minimal_and_perfect():
    for n in (0, 1, 2, 1000, 30_000):
        keys = mix(np.arange(n, dtype=np.uint64), 3)
        assert sorted(PerfectHash.build(keys).slots(keys).tolist()) == list(range(n))
    with pytest.raises(ValueError):
        PerfectHash.build(np.array([1, 1], dtype=np.uint64))


def test_warc_round_trip_on_odd_rows(spark):
    big, other = "é" * 600, "<p>" * 400
    rows = [(1, "http://a/1", big, 9), (2, None, big, 9), (3, "http://a/\r\n3", "short", 9), (4, "http://a/4", "short", 9), (5, "u", None, 9), (5, "u", "", 9), (6, "u", other, 9), (6, "u", other, 9), (7, "u", other + "x", 9), (None, "u", big, 9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, offset int")
    index = warc.write_archives(pages)
    got = warc.read_records(index).collect()
    payload = {(2, big), (3, "short"), (4, "short"), (5, ""), (6, other), (7, other + "x")}
    assert {(r.page_id, bytes(r.payload).decode()) for r in got if r.payload is not None} == payload
    assert sorted((str(r.page_id), r.record_type, r.refers_to) for r in got if r.record_type == "revisit") == [("1", "revisit", 2), ("None", "revisit", 2)]
    assert sorted((r.payload_bytes, r.payload_digest) for r in got) == sorted((len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest()) for _, _, h, _ in rows)
    assert {r.url for r in got} == {"http://a/1", None, "http://a/%0D%0A3", "http://a/4", "u"}
    assert warc.read_records(index.where("page_id = 7")).select("page_id").collect()[0][0] == 7
    assert warc.read_records(warc.write_archives(pages.limit(0))).count() == 0


def test_decontamination_matches_brute_force(spark):
    items = {1: "zero one two three four five six seven eight nine ten", 2: "Alpha, BETA gamma", 3: None, 4: "!!", 5: "alpha beta gamma", 6: "one two three four five six seven eight nine ten"}
    texts = ["x one TWO three four five-six seven eight nine ten y zero", "alphabeta gamma", "alpha  beta\ngamma alpha beta gamma", "zero one two three four five six seven eight nine ten", "", None, "é alpha beta gammaé", LONG + " alpha beta gamma"]
    rows = [*enumerate(texts), (None, "alpha beta gamma"), (0, texts[0])]
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    for most in (decontaminate.MAX_BYTES, 40):
        got = decontaminate.find_passages(docs(spark, rows), bench, max_bytes=most, to="found").select("doc_id", "text", "found.*").collect()
        assert len(got) == len(rows)
        for r in got:
            want = decontaminate.brute_force(r.text, items)
            assert (r.n_words, r.n_hit, len(r.item_ids), hashlib.sha256(",".join(r.item_ids).encode()).hexdigest()) == want
            if r.n_hit:
                assert sum(len(decontaminate.words(r.text[s.start : s.end])) for s in r.spans) == r.n_hit
    rng = random.Random(8)
    vocabulary = "a b c".split()
    for size in (1, 2, 3, 10):
        many = {k: " ".join(rng.choices(vocabulary, k=rng.randrange(14))) for k in range(6)}
        passages = decontaminate.Passages([(str(k), t) for k, t in many.items()], size)
        for _ in range(60):
            text = " ".join(rng.choices([*vocabulary, "x"], k=rng.randrange(40))) + " " + many[rng.randrange(6)]
            n, hit, ids = passages.scan(text)
            assert (n, len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()) == decontaminate.brute_force(text, many, size)
    kept = decontaminate.drop_contaminated(docs(spark, rows), bench)
    assert kept.columns == docs(spark, []).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "4", "5", "6"]
    assert decontaminate.drop_contaminated(docs(spark, rows), bench.limit(0)).count() == len(rows)


def vector_brute_force(rows, threshold=0.98):
    ok = [(k, np.array(v, dtype=float), lab) for k, (_, v, lab) in enumerate(rows) if lab is not None and v and None not in v and np.isfinite(np.array(v, dtype=float)).all() and any(v)]
    near = [(a, b) for a, x, p in ok for b, y, q in ok if a != b and p == q and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold]
    of = components(range(len(rows)), near)
    least = {}
    for k, (i, _, _) in enumerate(rows):
        least[of[k]] = min(least.get(of[k], i), i)
    links = defaultdict(int)
    for a, _ in near:
        links[a] += 1
    return sorted((i, links[k], least[of[k]], i == least[of[k]]) for k, (i, _, _) in enumerate(rows))


@pytest.mark.parametrize("block", [2048, 16])
def test_embeddings_match_brute_force(spark, block):
    rng = np.random.default_rng(4)
    rows = []
    for _ in range(8):
        c = rng.normal(size=12)
        rows += [(len(rows) + k, (c + rng.normal(size=12) * 0.06).astype("f4").tolist(), int(rng.integers(2))) for k in range(25)]
    rows += [(len(rows) + k, rng.normal(size=12).astype("f4").tolist(), 1) for k in range(60)]
    rows += [(1000 + k, rows[0][1], rows[0][2]) for k in range(40)]
    rows += [(2000, None, 1), (2001, [0.0] * 12, 1), (2002, [float("nan")] + [1.0] * 11, 1), (2003, [None] + [1.0] * 11, 1), (2004, rows[0][1], None), (2005, [], 1), (2006, [1.0, 2.0], 1), (2007, [2.0, 4.0], 1), (2008, [float("inf")] * 12, 1), (2009, [1e-30, 2e-30], 1), (2010, [-0.0, 1.0], 0), (2011, [0.0, 1.0], 0)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<float>, label int, n_links string")
    got = embeddings.near_vectors(df, cells=6, block=block).collect()
    assert sorted(map(tuple, got)) == vector_brute_force(rows)
    assert embeddings.near_vectors(df.limit(0)).count() == 0


def test_embedding_links_are_found_in_many_cells(spark):
    rng = np.random.default_rng(9)
    rows, d = [], 64
    for k in range(500):
        c = rng.normal(size=d)
        rows += [(len(rows) + m, (c + (m > 0) * rng.normal(size=d) * np.linalg.norm(c) * rng.uniform(0.1, 0.22) / np.sqrt(d)).tolist(), k % 2) for m in range(1 + k % 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want = {(i, n) for i, n, *_ in vector_brute_force(rows)}
    assert sum(n for _, n in want) > 600
    for cells in (1, 32):
        got = {(r.vec_id, r.n_links) for r in embeddings.near_vectors(df, cells=cells).collect()}
        assert sum(n for _, n in got) >= 0.999 * sum(n for _, n in want) and len(got & want) >= 0.999 * len(want)
    assert {(r.vec_id, r.n_links) for r in embeddings.near_vectors(df, cells=32, margin=0.2).collect()} == want


def test_piece_transducer_matches_the_library(spark):
    import sentencepiece

    s = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    t = piece_transducer.compile_model(PIECES)
    e = piece_transducer.Encoder(t)
    rng = random.Random(7)
    pieces = [p.replace("▁", " ") for p in t.pieces]
    texts = [x or "" for _, x in ODD] + ["".join(rng.choices([*rng.sample(pieces, 40), " ", "  ", "\n", "▁", "é́", "😀", "\x00", "中", "ẞ"], k=rng.randrange(9))) for _ in range(3000)]
    for text in texts:
        assert e.encode(text) == s.encode(text)
        assert e.decode(e.encode(text)) == s.decode(s.encode(text))
    for _ in range(500):
        ids = rng.choices([0, 1, 2, 3, 35, 130, 198, 230, 259, 261, 300, 28705], k=8)
        assert e.decode(ids) == s.decode(ids)
    rows = piece_transducer.encode_and_decode(docs(spark, ODD), PIECES).collect()
    assert all(r.round_trip for r in rows) and len(rows) == len(ODD)
    assert sorted((str(r.doc_id), r.n_pieces) for r in rows) == sorted((str(i), len(s.encode(x or ""))) for i, x in ODD)
    back = piece_transducer.decoded(piece_transducer.encoded(docs(spark, ODD), PIECES).drop("text"), PIECES).collect()
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted((str(i), (x or "").replace("▁", " ")) for i, x in ODD)


def test_unigram_shortest_path():
    pieces = {"▁": (1, -3.0), "a": (2, -2.0), "b": (3, -2.0), "ab": (4, -1.5), "ba": (5, -1.0), "▁a": (6, -2.4)}
    surface, types = ["<unk>", *pieces, "<0x63>"], [2, *[1] * 6, 6]
    e = piece_transducer.Encoder(piece_transducer.build(1, pieces, surface, types, {0x63: 7}, 0))

    def best(x):
        ways = {0: (0.0, ())}
        for end in range(1, len(x) + 1):
            options = [(ways[k][0] + pieces[x[k:end]][1], (*ways[k][1], pieces[x[k:end]][0])) for k in range(max(0, end - 2), end) if x[k:end] in pieces]
            if x[end - 1] == "c":
                options.append((ways[end - 1][0] - 13.0, (*ways[end - 1][1], 7)))
            ways[end] = max(options)
        return ways[len(x)][1]

    texts = ["ab", "aba", "bab", "abcab", "aab", "abacab" * 20]
    assert [e.encode(x) for x in texts] == [list(best("▁" + x)) for x in texts]


def test_weights_tell_what_merging_leaves():
    t = piece_transducer.compile_model(PIECES)
    rng = random.Random(11)
    some = [p for p in t.pieces if len(p) < 9]
    pairs = [(rng.choice(some), rng.choice(some)) for _ in range(4000)] + [(p[:k], p[k:]) for p in rng.sample(some, 400) for k in range(1, len(p)) if p[:k] in t.pieces and p[k:] in t.pieces]
    weights = t.weight(*(np.array([t.pieces[x][0] for x in side]) for side in zip(*pairs, strict=True)))
    for (a, b), w in zip(pairs, weights, strict=True):
        *_, (_, merged) = piece_transducer.merge_steps(t.pieces, a + b)
        assert (w == 0) == (merged == [a, b])


def test_kept_stretches_are_bounded_in_bytes():
    import sentencepiece

    s = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    e = piece_transducer.Encoder(piece_transducer.compile_model(PIECES), kept_bytes=4000)
    rng = random.Random(4)
    spaceless = "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGH0123456789+/", k=1 << 20))
    for text in [*(f"word{k} tail{k % 7}" for k in range(200)), spaceless, "中" * 5000, "word1 tail1"]:
        assert e.encode(text) == s.encode(text)
        assert e.kept.size <= 4000 + 400 and all(len(k) <= 256 for k in [*e.kept.new, *e.kept.old])


def conversations_brute_force(rows):
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t is not None, t, role or "", text or ""))
    out = []
    for c, turns in by.items():
        turns.sort()
        said = "".join(x[3] for x in turns if x[2] == "assistant")
        out.append((str(c), len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for *_, r, x in turns).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest()))
    return sorted(out)


def test_chat_examples_read_back(spark):
    odd = "<|im_end|><|im_start|>assistant ok\\c\\b\\n \\<| <<||\n"
    rows = [(1, 0, "user", odd), (1, 1, "assistant", odd), (1, 2, "user", None), (1, 3, "assistant", "😀é"), (2, 0, "system", "x"), (2, 1, "user", ""), (3, 0, None, "a"), (3, 0, "role\nwith <|im_start|>", "b"), (3, None, "assistant", None), (None, 5, "assistant", LONG), (4, 1, "assistant", "twice"), (4, 1, "assistant", "twice")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    examples = chat.prefix_targets(df)
    got = chat.read_back(examples)
    assert sorted((str(r.conv_id), r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got.collect()) == conversations_brute_force(rows)
    first = examples.where("conv_id = 1 and target = 1").first()
    assert first.formatted.count("<|im_start|>") == 2 and first.formatted.count("<|im_end|>") == 2
    assert "Python" not in got._jdf.queryExecution().toString()
    assert chat.read_back(chat.prefix_targets(df.limit(0))).count() == 0


def url_brute_force(url):
    before, sep, rest = (url or "").partition("://")
    if not sep:
        return "", ""
    end = min([k for k, c in enumerate(rest) if c in "/?#"], default=len(rest))
    path = rest[end:]
    return rest[:end].translate({c: c + 32 for c in range(65, 91)}), path[: min([k for k, c in enumerate(path) if c in "?#"], default=len(path))]


def test_url_rules_and_trees(spark):
    urls = ["http://A.Example.NET/en/1?x=1#y", "https://x.net", "http://notexample.net/en/", "http://net/a", "http://example.com/de/1", "http://example.com/deutsch", "http://EXAMPLE.org/fr/", None, "", "no scheme/net/", "http://a.org/fr", "http://É.net/é", "http://x.net?://y.org/fr/", "a://b://c/d", "http://\n.net/\n", "http://q.com/" + "1" * 50_000]
    df = spark.createDataFrame([(k, u, "clash") for k, u in enumerate(urls)], "page_id long, url string, host string")
    judged = url_filter.judge(df, queries.RULES)
    got = {r.page_id: r for r in judged.collect()}
    assert "Python" not in judged._jdf.queryExecution().toString()
    assert len(got) == len(urls)
    for k, u in enumerate(urls):
        host, path = url_brute_force(u)
        fits = [r for r in queries.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        rule = max(fits, key=lambda r: len(r.pattern), default=None)
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, rule and rule.pattern), u
        assert got[k].verdict == rule.verdict if rule else got[k].verdict in ("allow", "block")
    assert url_filter.judge(df.limit(0), queries.RULES).count() == 0


def test_trees_learn_a_lexical_rule(spark):
    rows = [(k, f"http://h{k % 7}.com/{'9' * (k % 20)}a", int(k % 20 > 9)) for k in range(600)]
    labelled = spark.createDataFrame(rows, "page_id long, url string, y int")
    got = url_filter.judge(labelled.select("page_id", "url"), [], labelled).join(labelled, "page_id")
    assert got.where("(verdict = 'block') = (y = 1)").count() >= 590


def test_tree_columns_give_mllibs_margins(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    pages = queries.table(spark, SF, "pages")
    named = url_filter.described(pages.select("page_id", "url"))
    known = url_filter.with_site_statistics(url_filter.labelled_by_rules(named, queries.RULES), named)
    margin, model = url_filter.train_trees(known.where("by_rule is not null"), url_filter._LEXICAL)
    given = model.transform(VectorAssembler(inputCols=url_filter._LEXICAL, outputCol="features").transform(known.withColumn("margin", margin)))
    rows = given.select("page_id", "margin", "prediction", vector_to_array("rawPrediction")[1].alias("raw")).collect()
    assert len(rows) == pages.count()
    assert all(abs(r.margin - r.raw / 2) < 1e-9 or abs(r.margin - r.raw) < 1e-9 for r in rows)
    assert all((r.margin > 0) == (r.prediction == 1.0) for r in rows)
    judged = {r.page_id: r for r in url_filter.judge(pages, queries.RULES).collect()}
    assert all(judged[r.page_id].verdict == ("block" if r.prediction == 1.0 else "allow") for r in rows if judged[r.page_id].rule is None)
    assert sum(r.n for r in url_filter.held_out_verdicts(pages, queries.RULES).collect()) > 0


def test_suffix_rates_are_out_of_fold(spark):
    rows = [(k, f"http://a{k}.x.com/{k}", int(k % 3 == 0)) for k in range(60)] + [(100 + k, "http://one.site.org/", 1) for k in range(20)]
    known = url_filter.described(spark.createDataFrame(rows, "page_id long, url string, y int"))
    counts = {"top": url_filter.suffix_counts(known, "top")}
    got = {r.page_id: r for r in url_filter.with_rates(known.withColumn("fold", url_filter._fold()), counts, True).collect()}
    for i, _, _ in rows:
        others = [y for k, _, y in rows if got[k].top == got[i].top and got[k].fold != got[i].fold]
        assert abs(got[i].top_rate - (sum(others) + 5) / (len(others) + 10)) < 1e-12
    assert all(got[100 + k].top_rate == 0.5 for k in range(20))  # all of one site: nothing is left
    whole = {r.page_id: r.top_rate for r in url_filter.with_rates(known, counts, False).collect()}
    assert abs(whole[100] - 25 / 30) < 1e-12


def test_toxicity_learns_from_labels_and_handles_odd_texts(spark):
    rng = random.Random(1)
    syllables = ["the", "on", "er", "tion", "ha", "st", "in", "re", "wh", "le"]

    def text(bad):
        words = ["".join(rng.choices(syllables, k=rng.randrange(1, 4))) for _ in range(rng.randrange(40, 120))]
        return " ".join(words[:20] + ["vilebrute", "scoundrel"][: 2 * bad] + words[20:]) + "."

    rows = [(k, text(k % 5 == 0)) for k in range(600)]
    model = toxicity.train([(t, int(k % 5 == 0)) for k, t in rows[:400]])
    scored = {r.doc_id: r.found for r in toxicity.score(docs(spark, rows[400:] + [(1000, None), (1001, ""), (1002, LONG), (1003, "...")]), model, to="found").collect()}
    assert all((scored[k] >= 0.7) == (k % 5 == 0) for k, _ in rows[400:])
    assert all(0 <= s <= 1 for s in scored.values()) and scored[1000] == scored[1001] == scored[1003] < 0.7
    kept = toxicity.drop_toxic(docs(spark, rows[400:]), model)
    assert kept.columns == docs(spark, []).columns and kept.count() == 160
    empty = toxicity.train_on(docs(spark, []).select("doc_id", "text"), spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(docs(spark, ODD), empty, to="found").where("found = 0").count() == len(ODD)


def test_toxicity_learns_from_overused_words_and_from_a_rare_language():
    rng = random.Random(3)

    def text(kind, y):
        syllables, words, low = (["the", "on", "er", "tion", "ha", "st"], ["vilebrute", "scoundrel"], 1) if kind else (["gro", "lau", "mik", "pez", "dul", "vas"], ["schurkenpack", "lumpenhund"], 0)
        body = ["".join(rng.choices(syllables, k=rng.randrange(1, 4))) for _ in range(80)]
        return " ".join(body[:40] + rng.choices(words, k=6 if y else low * (rng.random() < 0.3)) + body[40:])

    kinds = [k % 50 > 0 for k in range(2000)]
    model = toxicity.train([(text(kind, k % 4 == 1 or k % 100 == 0), int(k % 4 == 1 or k % 100 == 0)) for k, kind in enumerate(kinds)])
    gain = model.gains()
    for kind in (True, False):
        for y in (0, 1):
            assert sum((model.score(gain, text(kind, y)) >= 0.7) == bool(y) for _ in range(40)) >= 36


def test_toxicity_scores_by_definition(spark):
    """Scores again from the model's fields alone: two zstandard dictionaries, windows of words, thresholds, a logistic."""
    import math
    import re

    import zstandard as z

    table = queries.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    model = queries.toxicity_model(spark, table, "/root/testdata/sf0.01")
    assert model.weights and len(model.ordinary) == len(model.toxic)

    compressors = []
    for data in (model.ordinary, model.toxic):
        params = z.ZstdCompressionParameters.from_level(model.level, write_content_size=0, write_checksum=0, write_dict_id=0, format=z.FORMAT_ZSTD1_MAGICLESS)
        d = z.ZstdCompressionDict(data, dict_type=z.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=params)
        compressors.append(z.ZstdCompressor(dict_data=d, compression_params=params))

    def naive(text):
        words = re.findall("[a-z0-9\x80-\U0010ffff]+", (text or "").lower())
        diffs = []
        for i in range(0, len(words), model.window):
            x = (" " + " ".join(words[i : i + model.window]) + " ").encode() + toxicity._TRAILER
            sizes = [len(c.compress(x)) for c in compressors]
            diffs.append(sizes[0] - sizes[1])
        reach = [sum(d >= t for d in diffs) for t in model.thresholds]
        x = [min(24.0, max(-4.0, max(diffs, default=0))), *(math.log1p(n) for n in reach), *(math.log1p(100 * n / max(1, len(diffs))) for n in reach)]
        t = model.weights[0] + sum(w * (v - m) / s for w, v, m, s in zip(model.weights[1:], x, model.mean, model.scale, strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, t))))

    rows = ODD + [(r.doc_id + 100, r.text) for r in table.limit(40).collect()]
    scored = toxicity.score(docs(spark, rows).select("doc_id", "text"), model).collect()
    assert sorted((str(r.doc_id), round(r.score, 9)) for r in scored) == sorted((str(i), round(naive(t), 9)) for i, t in rows)


def test_held_out_rows_are_never_learned_from(spark):
    got = spark.range(50).select("id", queries.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in got)


def test_pipeline_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "benchmark_decontamination", "sentencepiece"]
    df = queries.table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, SF)
        assert df.columns == queries.table(spark, SF, "documents").columns
    want = {r.doc_id for r in df.collect()}
    got = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in got.collect()} == want and 0 < len(want) < 200


def plain_pipeline(rows, model, items):
    """The pipeline in plain Python: (id, pieces, characters decoded) of what stays."""
    import sentencepiece

    s = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    gains = model.gains()
    rows = [r for r in rows if model.score(gains, r[1]) < 0.7]
    prints = [naive_fingerprint(t) for _, t in rows]
    of = components(range(len(rows)), [(a, b) for a in range(len(rows)) for b in range(a + 1, len(rows)) if (prints[a] ^ prints[b]).bit_count() <= 2])
    best = {}
    for k, (i, _) in enumerate(rows):
        order = (i is None, i or 0)
        if of[k] not in best or order < best[of[k]][0]:
            best[of[k]] = order, k
    rows = [rows[k] for _, k in best.values()]
    rows = [r for r in rows if not decontaminate.brute_force(r[1], items)[1]]
    return sorted((str(i), len(s.encode(t or "")), len(s.decode(s.encode(t or "")))) for i, t in rows)


def test_pipeline_matches_plain_python_on_odd_rows(spark, tmp_path):
    real = [(r.doc_id + 100, r.text) for r in queries.table(spark, SF, "documents").collect()]
    odd = [(i, t and t[:20_000]) for i, t in ODD if i != 7] + [(7, "One TWO three four"), (8, "seven words that stand only once here"), (8, "and eight other words that stand once too")]
    names = ["documents", "labels", "benchmark"]
    docs(spark, odd + real).write.parquet(f"{tmp_path}/documents.parquet")
    queries.table(spark, SF, "labels").withColumn("doc_id", F.col("doc_id") + 100).write.parquet(f"{tmp_path}/labels.parquet")
    queries.table(spark, SF, "benchmark").write.parquet(f"{tmp_path}/benchmark.parquet")
    model = queries.toxicity_model(spark, queries.table(spark, str(tmp_path), "documents"), str(tmp_path))
    items = {r.item_id: r.text for r in queries.table(spark, SF, "benchmark").collect()}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.n_pieces, r.n_chars_decoded) for r in got) == plain_pipeline(odd + real, model, items)
    for name in names:
        queries.table(spark, str(tmp_path), name).limit(0).write.parquet(f"{tmp_path}/empty/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0


def test_store_names_and_temporary_tables(spark, tmp_path):
    from bytelode.llm import common

    assert common.arrow_uri("s3a://bucket/a") == "s3://bucket/a" and common.arrow_uri("/a/b") == "/a/b"
    path = f"{tmp_path}/gone"
    spark.range(3).write.parquet(path)
    common.discard(spark, path)
    assert not (tmp_path / "gone").exists()


def test_encoder_with_full_caches_gives_the_library_ids():
    with open(BPE, encoding="utf-8") as f:
        tokenizer_json = f.read()
    library, whole = tokens.load(tokenizer_json), tokens.prove_whole(tokenizer_json)
    encoder, counter = tokens.TokenEncoder(tokenizer_json, "<u2", kept_bytes=600), tokens.TokenCounter(tokenizer_json, whole, kept_bytes=600)
    for text in ["one two three four five six one two", "don't  stop\n\n\tnow\x00\x7f\x1f", "né 中文🙂\xa0　x\x85", "<|endoftext|> a<|endoftext|>", " ", "", "spaceless" * 120_000] * 2:
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode(text), dtype="<u2").tolist() == want
        assert counter.count(text) == len(want)
        for kept in (encoder.kept, counter.kept):
            assert len(kept.new) <= 30 and len(kept.old) <= 30 and all(len(k) <= 256 for k in [*kept.new, *kept.old])
    assert encoder.encode(None) == b"" and counter.count(None) == 0


def test_pretokens_of_all_old_characters_are_the_librarys():
    with open(BPE, encoding="utf-8") as f:
        tokenizer_json = f.read()
    encoder, library = tokens.TokenEncoder(tokenizer_json, "<u4"), tokens.load(tokenizer_json)
    texts = [f"a{chr(c)}b {chr(c)}1{chr(c)}{chr(c)}'s " for c in [*range(0x540), *range(0x2000, 0x2070), 0x3000, 0x1F600]]
    for x, data in zip(texts, encoder.encode_all(texts), strict=True):
        assert np.frombuffer(data, dtype="<u4").tolist() == library.encode(x, add_special_tokens=False).ids
