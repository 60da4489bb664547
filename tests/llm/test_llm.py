import hashlib
import random
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import chat_format, common, decontaminate, mixing, near_dedup, queries, revisits, shard, syncmers, token_store, toxicity, url_filter
from fixtures import DOCS, ODD, SF, VOCABULARY, WIDE, documents, with_broken, words
from quillspark.llm.common import table


# op1


def test_chat_matches_a_plain_reading(spark):
    rows = [(1, 0, "user", "a<|im_end|>\n<\\|im_end|>"), (1, 1, "assistant", "</s>[INST] x <\\\\/s>"), (1, 1, "assistant", "again"), (2, None, None, None), (3, 0, "od\nd\\n", "t"), (None, 0, "assistant", "é🔐")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_turns(turns)).collect()}
    by = {}
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        by.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    assert set(got) == set(by)
    for k, said in by.items():
        loss = "".join(t for role, t in said if role == "assistant")
        assert got[k].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in said).encode()).hexdigest()
        assert (got[k].n_turns, got[k].loss_chars, got[k].loss_sha256) == (len(said), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_escapes_leave_no_control_string(spark):
    r = random.Random(1)
    texts = ["".join(r.choice([*chat_format.CONTROL, "<", "[", "\\", "s>", "x"]) for _ in range(12)) for _ in range(300)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat_format.escape(F.col("t")).alias("e")).collect()
    for row in got:
        assert not any(c in row.e for c in chat_format.CONTROL) and chat_format.unescape(row.e) == row.t


def test_chat_layouts(spark):
    for schema, row, want in (
        ("k bigint, prompt string, response string, note string", (1, "p", "r", "n"), [("user", "p"), ("assistant", "r")]),
        ("k bigint, prompt string, response string, turn bigint, conv_id string, said string", (1, None, "r", 7, "x", "y"), [("user", None), ("assistant", "r")]),
        ("k bigint, instruction string, input string, output string", (1, "i", "", "o"), [("user", "i"), ("assistant", "o")]),
        ("k bigint, instruction string, input string, output string", (1, "i", "n", None), [("user", "i\n\nn"), ("assistant", None)]),
        ("k bigint, messages array<struct<role string, content string>>", (1, [("user", "a"), ("assistant", "b")]), [("user", "a"), ("assistant", "b")]),
        ("k bigint, messages array<struct<role string, content string>>", (1, []), [(None, None)]),
        ("k bigint, messages array<struct<role string, content string>>", (1, None), [(None, None)]),
        ("k bigint, conversations array<struct<from string, value string>>", (1, [("human", "a"), ("gpt", "b"), None]), [("user", "a"), ("assistant", "b"), (None, None)]),
        ("k bigint, turn bigint, role string, text string, extra string", (1, 4, "user", "t", "x"), [("user", "t")]),
    ):
        records = spark.createDataFrame([row], schema)
        got = chat_format.canonical_turns(records, "k").orderBy("turn").collect()
        assert [(r.role, r.text) for r in got] == want and chat_format.canonical_turns(records.limit(0), "k").count() == 0
    assert got[0].turn == 4
    with pytest.raises(ValueError):
        chat_format.canonical_turns(spark.createDataFrame([(1,)], "z int"), "k")


def test_chat_json_records(spark):
    cases = {
        '{"prompt":"p","response":"r"}': [("user", "p"), ("assistant", "r")],
        '{"prompt":"p","response":"r","id":3}': [("user", "p"), ("assistant", "r")],
        '{"system":"s","prompt":null,"response":"r"}': [("system", "s"), ("user", None), ("assistant", "r")],
        '{"instruction":"i","input":"n","output":5}': [("user", "i\n\nn"), ("assistant", "5")],
        '{"messages":[{"content":"c","role":"user"},{"role":"assistant","content":null,"name":"x"}]}': [("user", "c"), ("assistant", None)],
        '{"conversations":[{"from":"human","value":"\\ud800"},{"from":"gpt","value":""}]}': [("user", "\ufffd"), ("assistant", "")],
        '{"messages":[]}': [(None, '{"messages":[]}')],
        '{"messages[].role":1,"messages[].content":2}': [(None, '{"messages[].role":1,"messages[].content":2}')],
        "no json": [(None, "no json")],
        "[" * 100_000: [(None, "[" * 100_000)],
        "": [(None, "")],
    }
    rows = [*enumerate(cases), (None, None), (None, None)]
    df = spark.createDataFrame([(k, j, "x") for k, j in rows], "k bigint, j string, turn string")
    got = {}
    for r in chat_format.canonical_json_turns(df, "k", "j").collect():
        got.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    assert got.pop(None) == [(0, None, None)] * 2
    assert got == {k: [(i, *t) for i, t in enumerate(turns)] for k, turns in enumerate(cases.values())}
    assert chat_format.canonical_json_turns(df.limit(0), "k", "j").count() == 0


def test_chat_odd_rows(spark):
    turns = spark.createDataFrame([(1, 0, "user", "long " * 300_000, "x"), (1, 1, "assistant", "y", "x")], "conv_id bigint, turn bigint, role string, text string, segment string")
    broken = turns.limit(1).withColumn("conv_id", F.lit(2).cast("bigint")).withColumn("role", F.lit("assistant")).withColumn("text", F.lit(b"a\xff</s>").cast("string"))
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_turns(turns.union(broken))).collect()}
    assert got[1].turns_sha256 == hashlib.sha256(("user\n" + "long " * 300_000 + "\nassistant\ny\n").encode()).hexdigest()
    assert (got[2].loss_chars, got[2].loss_sha256) == (6, hashlib.sha256("a\ufffd</s>".encode()).hexdigest())
    assert chat_format.read_back(chat_format.format_turns(turns.limit(0))).count() == 0


# op2


def test_urls(spark):
    urls = ["http://A.Example.NET/en/x?q#f", "https://m.example.net/de/", "http://net/x", "http://example.com/de/1", "http://xexample.com/de/1", "http://a.org/fr/", "http://a.net", "no url", None, "", "x://", "http://u@a.net:80/p", "http://a.net?x=/", "http://a.net/\n/z"]
    pages = spark.createDataFrame([(i, u, "h", "w") for i, u in enumerate(urls)], "page_id bigint, url string, host string, rule string")

    def brute(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
        fits = [(len(h + p), h + p, a) for a, h, p in url_filter.RULES if (host == h or host.endswith(f".{h}")) and path.startswith(p)]
        return (host, path, *(max(fits)[1:] if fits else (None, "allow")))

    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, url_filter.rule_table(spark)).collect()}
    assert got == {i: brute(u) for i, u in enumerate(urls)}
    assert {r.verdict for r in url_filter.judge(pages, url_filter.rule_table(spark).limit(0), "block").collect()} == {"block"}
    assert url_filter.judge(pages.limit(0), url_filter.rule_table(spark)).count() == 0
    odd = spark.createDataFrame([(None, "http://net/" + "x" * 500_000), (None, "http://net/" + "x" * 500_000)], "page_id bigint, url string")
    odd = odd.union(odd.limit(1).withColumn("url", F.lit(b"http://a.net/\xff").cast("string")))
    assert [(r.rule, r.verdict) for r in url_filter.judge(odd, url_filter.rule_table(spark)).collect()] == [("net/", "block")] * 3


def test_a_hot_url_is_split(spark):
    pages = spark.range(0, 60_000, 1, 8).select(F.col("id").alias("page_id"), F.when(F.col("id") % 3 == 0, "http://a.net/hot").otherwise(F.concat(F.lit("http://b.org/"), "id")).alias("url"))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.shuffle.partitions")}
    try:
        for k, v in zip(kept, ("-1", "10000", "5000", "16"), strict=True):
            spark.conf.set(k, v)
        out = url_filter.judge(pages, url_filter.rule_table(spark))
        assert out.where("verdict = 'block'").count() == 20_000
        out.collect()
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)




def test_many_rules_take_the_salted_join(spark, monkeypatch):
    want = sorted(map(tuple, queries.op2_url_filter(spark, SF).collect()), key=str)
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", 0)
    assert sorted(map(tuple, queries.op2_url_filter(spark, SF).collect()), key=str) == want


# op3


def brute_syncmers(text):
    """Positions by the definition, one k-mer at a time."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    inner = syncmers._rolled(codes, syncmers.S).tolist()
    span = syncmers.K - syncmers.S + 1
    return [i for i in range(len(text) - syncmers.K + 1) if min(inner[i : i + span]) in (inner[i], inner[i + span - 1])]


def test_syncmers(spark):
    t = words(7, 200)
    assert syncmers.syncmers(t)[1].tolist() == brute_syncmers(t)
    inserted = t[:300] + "zzzz" + t[300:]  # context-free: the rest of the anchors only move
    moved = {i + 4 if i >= 300 else i for i in brute_syncmers(t) if not 300 - syncmers.K < i < 300}
    assert moved <= set(syncmers.syncmers(inserted)[1].tolist())
    for x in ("", "a", "short", t):
        f = syncmers.sketch(x)
        assert syncmers.likeness(f, f) == 1 and all((a == b).all() for a, b in zip(syncmers.read(syncmers.written(f)), f, strict=True))
    assert syncmers.likeness(syncmers.sketch(""), syncmers.sketch(t)) == 0
    r = random.Random(8)
    short = ["".join(r.choice("ab c") for _ in range(n)) for n in range(1, 24) for _ in range(20)]
    for x in short:
        at = brute_syncmers(x) if len(x) >= syncmers.K else []
        assert syncmers.syncmers(x)[1].tolist() == (at or [0])
    alone = {x for x in short if len(x) >= syncmers.K and not brute_syncmers(x)}
    assert alone and len({int(syncmers.syncmers(x)[0][0]) for x in alone}) == len(alone)  # the whole text, not its beginning


M = 2**64 - 1


def plain_mix(h):
    h = ((h ^ (h >> 33)) * 0xFF51AFD7ED558CCD) & M
    return h ^ (h >> 29)


def plain_roll(text):
    h = 0
    for c in text:
        h = (h * 0x9E3779B97F4A7C15 + ord(c) + 1) & M
    return plain_mix(h)


def plain_anchors(text):
    """{hash: first position}, in whole numbers, one k-mer at a time."""
    k, s = syncmers.K, syncmers.S
    out = {}
    for i in range(len(text) - k + 1):
        inner = [plain_roll(text[j : j + s]) for j in range(i, i + k - s + 1)]
        if min(inner) in (inner[0], inner[-1]):
            out.setdefault(plain_mix((inner[0] * 3 + inner[s] * 5 + inner[-1] * 7) & M) >> 32, i)
    return out or ({plain_roll(text) >> 32: 0} if text else {})


def plain_likeness(x, y):
    if not x and not y:
        return 1.0
    pairs = sorted((x[h], y[h]) for h in x.keys() & y.keys())
    chain = [1] * len(pairs)  # the longest rising chain that ends at each
    for i, (p, q) in enumerate(pairs):
        chain[i] += max((chain[j] for j, (a, b) in enumerate(pairs[:i]) if a < p and b < q), default=0)
    return max(chain, default=0) / len(x.keys() | y.keys())


def test_fingerprints_against_plain_arithmetic(spark):
    docs = with_broken(documents(spark, [(i, t) for i, t in ODD if i != 8] + [(20, words(70, 150) + " " + words(71, 100)), (21, words(71, 100) + " " + words(70, 150))]))
    rows = sorted((r.doc_id is not None, r.doc_id or 0, bytes(r.raw or b"")) for r in docs.select("doc_id", F.col("text").cast("binary").alias("raw")).collect())
    want = []
    for k, (known, i, raw) in enumerate(rows):
        t, n = raw.decode("utf-8", "replace"), rows[(k + 1) % len(rows)][2].decode("utf-8", "replace")
        half = len(t) // 2
        e = t[: len(t) - half] + n[:half]
        f = [plain_anchors(x) for x in (t, e, n)]
        text = lambda a: " ".join(f"{h:08x}@{a[h]}" for h in sorted(a))
        want.append((i if known else None, len(t), hashlib.sha256(e.encode()).hexdigest(), text(f[0]), text(f[1]), plain_likeness(f[0], f[1]), plain_likeness(f[0], f[2])))
    assert sorted(map(tuple, syncmers.fingerprints(docs).collect()), key=str) == sorted(want, key=str)


def test_long_texts_keep_their_anchors(spark):
    t = words(33, 6000)
    f = syncmers.sketch(t)
    assert {*f[1].tolist()} == {*brute_syncmers(t)}
    for at in (5_000, 15_000, 25_000):  # one letter differs
        g = syncmers.sketch(t[:at] + "z" + t[at + 1 :])
        assert syncmers.written(g) != syncmers.written(f) and 0.99 < syncmers.likeness(f, g) < 1
    passage = words(34, 60)
    g, h = (syncmers.sketch(f"{words(i, 6000)} {passage} {words(i + 1, 6000)}") for i in (35, 37))
    shared = {*syncmers.sketch(passage)[0].tolist()}
    assert shared <= {*g[0].tolist()} & {*h[0].tolist()} and syncmers.likeness(g, h) > 0
    assert syncmers.likeness(g, h) >= len(shared) / (len(g[0]) + len(h[0]))


@pytest.mark.parametrize("rows_a_range", [3, 1000])
def test_fingerprints(spark, monkeypatch, rows_a_range):
    from quillspark.llm import ordered

    monkeypatch.setattr(ordered, "RANGE_ROWS", rows_a_range)
    docs = documents(spark, ODD, WIDE)
    got = syncmers.fingerprints(docs).collect()
    rows = sorted(((i is not None, i or 0, (t or "").encode()) for i, t in ODD))
    want = []
    for k, (known, i, raw) in enumerate(rows):
        t, n = raw.decode(), rows[(k + 1) % len(rows)][2].decode()
        e = syncmers.edited(t, n)
        s = syncmers.sketch
        want.append((i if known else None, len(t), hashlib.sha256(e.encode()).hexdigest(), syncmers.written(s(t)), syncmers.written(s(e)), syncmers.likeness(s(t), s(e)), syncmers.likeness(s(t), s(n))))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert syncmers.fingerprints(docs.limit(0)).count() == 0
    lone = syncmers.fingerprints(documents(spark, [(1, "abcd")])).first()
    assert lone.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and lone.near_next == 1


# op5


@pytest.mark.parametrize("rows_a_range", [3, 1000])
def test_token_store(spark, tmp_path, monkeypatch, rows_a_range):
    from tokenizers import Tokenizer

    from quillspark.llm import ordered

    monkeypatch.setattr(ordered, "RANGE_ROWS", rows_a_range)
    odd = [*ODD, (10, "It's 12 <|endoftext|> ÉCOLE e\u0301\u3000x\u00a0y\tz \u0301a\x1cb ΟΔΟΣ don'T"), (11, "<|startoftext|><|endoftext|>")]
    token_store.write(documents(spark, odd, WIDE), str(tmp_path / "s"), VOCABULARY)
    stored = token_store.read(spark, str(tmp_path / "s"))
    t, at, want = Tokenizer.from_file(VOCABULARY), 0, []
    for known, i, raw in sorted((i is not None, i or 0, (x or "").encode()) for i, x in odd):
        ids = [*t.encode(raw.decode(), add_special_tokens=False).ids, 1]
        want.append((i if known else None, at, len(ids), ids))
        at += len(ids)
    assert sorted(map(tuple, stored.collect()), key=str) == sorted(want, key=str)
    got = {(r.start): r.ids_crc32 for r in token_store.digests(stored).collect()}
    assert got == {s: zlib.crc32(np.array(ids, "<u4").tobytes()) for _, s, _, ids in want}
    assert [r.doc_id for r in token_store.lookup(spark, str(tmp_path / "s"), [6]).collect()] == [6]
    token_store.write(documents(spark, odd).limit(0), str(tmp_path / "e"), VOCABULARY)
    assert token_store.read(spark, str(tmp_path / "e")).count() == 0


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_token_store_whole_table(spark, tmp_path, file):
    """Every document of sf0.01, and one that isn't UTF-8, against the library."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path(file)
    docs = with_broken(table(spark, "/root/testdata/sf0.01", "documents"))
    t, at, want = Tokenizer.from_file(path), 0, []
    for i, raw in sorted((r.doc_id, bytes(r.raw or b"")) for r in docs.select("doc_id", F.col("text").cast("binary").alias("raw")).collect()):
        ids = [*t.encode(raw.decode("utf-8", "replace"), add_special_tokens=False).ids, 1]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, token_store.encoded(docs, path).collect())) == want


def test_tokenizer_is_kept_between_tasks(tmp_path, monkeypatch):
    """A process loads a tokenizer file once, and again when it has changed; more words than the cache holds change no ids."""
    from tokenizers import Tokenizer

    loads, path = [], tmp_path / "t.json"

    class Counted:
        @staticmethod
        def from_file(name):
            loads.append(name)
            return Tokenizer.from_file(name)

    monkeypatch.setattr("tokenizers.Tokenizer", Counted)
    monkeypatch.setattr(token_store, "CACHED_WORDS", 3, raising=False)
    said = [b"It's", b"", "\u00c9COLE e\u0301 <|endoftext|> 12".encode(), b" ".join(b"word%d some%dthing" % (k, k) for k in range(50))] * 2
    for n, file in enumerate(["word_bpe_49k.json", "byte_bpe_50k.json"], 1):
        path.write_bytes(Path(public_tokenizers.path(file)).read_bytes())
        library = Tokenizer.from_file(str(path))
        want = [np.array(library.encode(x.decode(), add_special_tokens=False).ids, "<u4").tobytes() for x in said]
        for _ in range(3):
            assert token_store.encoder(str(path))(said) == want
        assert len(loads) == n


def test_orc_has_indexes_and_bloom_filters(spark, tmp_path):
    token_store.write(table(spark, SF, "documents"), str(tmp_path / "s"), VOCABULARY)
    part = str(next((tmp_path / "s" / "ids").glob("part-*.orc")))
    sc = spark.sparkContext
    orc, gateway = sc._jvm.org.apache.orc, sc._gateway
    rows = orc.OrcFile.createReader(sc._jvm.org.apache.hadoop.fs.Path(part), orc.OrcFile.readerOptions(sc._jsc.hadoopConfiguration())).rows()
    columns = gateway.new_array(gateway.jvm.boolean, 7)  # the row itself, its five columns, the array's items
    for k in range(7):
        columns[k] = True
    index = rows.readRowIndex(0, columns, columns)
    assert index.getBloomFilterIndex()[2].getBloomFilterCount() == 1 and index.getRowGroupIndex()[2].getEntryCount() == 1  # doc_id
    rows.close()


# op6


def brute_components(rows, size, percent):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            both = len(x & sets[j])
            if x and sets[j] and 100 * both >= percent * (len(x) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(find(i), []).extend([d] if d is not None else [])
    return sorted(((d, len(s), min(ids[find(i)], default=None)) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def near_copies(seed, n, copies, edits):
    r = random.Random(seed)
    base = words(seed, n).split()
    for _ in range(copies):
        w = list(base)
        for _ in range(r.randrange(edits + 1)):
            w[r.randrange(n)] = words(r.random(), 1)
        yield " ".join(w)


@pytest.mark.parametrize("few", [near_dedup.FEW, 10])
def test_near_duplicates_match_all_pairs(spark, monkeypatch, few):
    monkeypatch.setattr(near_dedup, "FEW", few)
    monkeypatch.setattr(near_dedup, "BLOCK_X", 7)
    monkeypatch.setattr(near_dedup, "BLOCK_Y", 13)
    texts = [t for s in range(6) for t in near_copies(s, 120, 25, 16)] + [x.upper() for x in near_copies(1, 120, 2, 2)]
    rows = [(i, t) for i, t in enumerate(texts, 100)] + [r for r in ODD if r[0] != 8]
    got = near_dedup.near_duplicates(documents(spark, rows, WIDE), 2, 80).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_components(rows, 2, 80)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert near_dedup.near_duplicates(documents(spark, rows).limit(0), 2).count() == 0


def test_near_duplicates_whole_table(spark):
    docs = table(spark, SF, "documents")
    got = near_dedup.near_duplicates(docs, 5, 80).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_components([(r.doc_id, r.text) for r in docs.collect()], 5, 80)


def test_near_duplicates_repeated_rows_and_long_texts(spark):
    long = words(80, 30_000)
    rows = [(1, words(81, 60))] * 200 + [(1, words(81, 59))] * 200 + [(2, long), (3, long.replace(" ", "  ") + " x"), (4, "a b " * 20_000), (5, "b a " * 20_000)]
    docs = with_broken(documents(spark, rows, WIDE))
    got = near_dedup.near_duplicates(docs, 2, 80).collect()
    assert len(got) == len(rows) + 1
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 2), (3, 2), (4, 4), (5, 4), (-5, -5)}
    assert {r.doc_id for r in near_dedup.drop_near_duplicates(docs).collect()} == {1, 2, 4, -5}


def test_a_hot_band_is_split(spark, monkeypatch):
    """Many classes in one bucket: the joins by band read it in parts, as many as tasks wrote it."""
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10000",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "5000",
        "spark.sql.shuffle.partitions": "61",
        "spark.sql.files.maxPartitionBytes": "30000",
        "spark.sql.files.openCostInBytes": "1000",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    kept = {k: spark.conf.get(k) for k in conf}
    plans, put = {}, near_dedup.materialize

    def watched(df, tag, paths=None):
        out = put(df, tag, paths)
        if tag in ("buckets", "pivots"):
            df.collect()
            plans[tag] = df._jdf.queryExecution().executedPlan().toString()
        return out

    monkeypatch.setattr(near_dedup, "materialize", watched)
    base = words(90, 400)  # most texts share nearly all their words, and so nearly all bands
    texts = [f"{base} {words(1000 + i, 2)}" for i in range(1200)] + [words(5000 + i, 30) for i in range(200)]
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = near_dedup.near_duplicates(documents(spark, list(enumerate(texts))).repartition(8), 2, 80).collect()
        assert {r.component_id for r in got if r.doc_id < 1200} == {0} and sum(r.kept for r in got) == 201
        assert all("skew=true" in p for p in plans.values()) and len(plans) == 2, {k: "skew=true" in p for k, p in plans.items()}
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_drop_near_duplicates_keeps_columns(spark):
    docs = documents(spark, ODD, WIDE)
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 2, 3, 4, 4, 6, None, None, 8, 9]))


def test_pruning_keeps_similar_pairs():
    least = near_dedup.least_matches(0.8, 1e-5)
    r = np.random.RandomState(0)
    equal = np.cumsum(r.rand(20_000, near_dedup.HASHES) < 0.8, axis=1)[:, near_dedup.STEP - 1 :: near_dedup.STEP]
    assert (equal >= least).all(axis=1).mean() > 0.9995


@pytest.mark.parametrize("hashes", [near_dedup.HASHES, near_dedup.DEEP])
def test_pruning_misses_no_more_than_stated(hashes):
    least = near_dedup.least_matches(0.8, 1e-5, hashes)
    c, alive, lost = 0.8 + 0.2 / 256, {0: 1.0}, 0.0
    for k in range(1, hashes + 1):  # a hash at a time
        after = {}
        for m, p in alive.items():
            after[m], after[m + 1] = after.get(m, 0) + p * (1 - c), p * c
        if k % near_dedup.STEP == 0:
            low = least[k // near_dedup.STEP - 1]
            lost += sum(p for m, p in after.items() if m < low)
            after = {m: p for m, p in after.items() if m >= low}
        alive = after
    assert 0 < lost <= 1e-5 and lost == pytest.approx(near_dedup.missed(least, 0.8))
    assert near_dedup.missed(least, 0.5) > 0.99


# op7


def uneven(spark):
    docs = documents(spark, [(i, words(i, 20)) for i in range(400)])
    return docs.withColumn("source", F.expr("CASE WHEN doc_id % 10 = 0 THEN 'small' WHEN doc_id = 7 THEN NULL ELSE 'large' END")).where("doc_id <> 17")


@pytest.mark.parametrize("broadcast", [mixing.BROADCAST_SOURCES, 0])
def test_mixing_meets_its_limits(spark, monkeypatch, broadcast):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", broadcast)
    docs = uneven(spark)
    own = {r.source: r.n for r in docs.groupBy("source").agg(F.sum(mixing.token_count(F.col("text"))).alias("n")).collect()}
    got = mixing.mixed(docs, max_repeats=3.0)
    reads = {r.source: r.t / own[r.source] for r in got.groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}
    assert reads["large"] == 1 and max(reads.values()) <= 3.0 and reads[None] >= 2
    assert got.select("doc_id").distinct().count() == 399
    half = sum(own.values()) // 2
    some = mixing.mixed(docs, budget_tokens=half, max_repeats=3.0).agg(F.sum("n_tokens")).first()[0]
    assert 0.9 * half <= some <= half
    totals = docs.groupBy(mixing.source_key(F.col("source")).alias("key")).agg(F.sum(mixing.token_count(F.col("text"))).alias("tokens"))
    a = mixing.exponent(totals, None, 0.7)
    w = np.array([r.tokens for r in totals.collect()], float) ** a
    w /= w.sum()
    assert -(w * np.log(w)).sum() == pytest.approx(0.7, abs=1e-6)


def test_mixing_is_a_permutation_by_blocks(spark):
    docs = uneven(spark)
    got = [r.asDict() for r in mixing.mixed(docs, max_repeats=3.0).collect()]
    own = {s: sum(r["n_tokens"] for r in got if r["source"] == s and r["pass"] == 1) for s in ("small", "large", None)}
    target = {s: sum(r["n_tokens"] for r in got if r["source"] == s) for s in own}
    for r in got:
        assert r["place"] == hashlib.md5(f"{r['pass']}:{r['doc_id']}".encode()).hexdigest() and 1 <= r["pass"] <= r["copies"]
        share = int(r["place"], 16) / 16**32
        assert r["block"] / mixing.BLOCKS == pytest.approx(min(1, (r["pass"] - 1 + share) * own[r["source"]] / target[r["source"]]), abs=0.02)
    run = sorted(got, key=lambda r: (r["block"], r["place"]))
    for i in range(0, len(run) - 100, 50):  # any stretch has the sources at their weights
        assert sum(r["source"] == "small" for r in run[i : i + 100]) / 100 == pytest.approx(target["small"] / sum(target.values()), abs=0.12)
    at = {}
    for i, r in enumerate(run):
        at.setdefault(r["doc_id"], []).append(i)
    assert np.mean([b - a for x in at.values() for a, b in zip(x, x[1:])]) > len(run) / 5  # copies stand apart
    assert [r.doc_id for r in mixing.mix(docs, max_repeats=3.0).select("doc_id").collect()] == [r["doc_id"] for r in run]


def test_mixing_odd_rows(spark):
    docs = with_broken(documents(spark, ODD, WIDE)).withColumnsRenamed({"band": "__key", "score": "pass", "kept": "block"})
    out = mixing.mix(docs)
    counts = {str(r.doc_id): r.n for r in mixing.mixed(docs).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert out.columns == docs.columns and {str(r.doc_id): r["count"] for r in out.groupBy("doc_id").count().collect()} == counts
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mixed(docs.limit(0)).count() == 0
    assert {r.copies for r in mixing.mixed(documents(spark, [(1, None), (2, "")])).collect()} == {1}


# op8


def test_revisits(spark):
    rows = [
        (1, "http://A.com/x#f", 10, "response", {"ETag": "e", "Content-Length": "9", "Date": "d1", "Cache-Control": "a"}),
        (2, "https://www.a.com:443/x", 20, "revisit", {"etag": "e", "Content-Length": "0", "Date": "d2", "X-Other": "o"}),
        (3, "http://a.com/x", 10, "revisit", {"etag": "e"}),
        (4, "http://a.com/x", 8000, "revisit", {"ETag": "f"}),
        (5, "http://a.com/x", 9000, "revisit", None),
        (6, "http://a.com/x", 7000, "response", {"ETag": "e2", "Last-Modified": "m"}),
        (7, "http://a.com/x", 7000, "response", {"ETag": "f"}),
        (8, None, 7000, "revisit", {"ETag": "f"}),
        (9, "http://a.com/x", 50_000, "revisit", {"Last-Modified": "m"}),
        (10, "http://a.com/x?b=2&a=1", 1, "response", {"ETag": "q"}),
        (11, "http://a.com/x?a=1&b=2", 99_999, "revisit", {"ETag": "q"}),
        (2, "https://www.a.com:443/x", 20, "revisit", {"etag": "e", "Content-Length": "0", "Date": "d2", "X-Other": "o"}),
    ]
    got = revisits.resolve(spark.createDataFrame(rows, "record_id bigint, url string, ts bigint, kind string, headers map<string,string>").withColumn("status", F.lit(1)))
    by = {r.record_id: (r.response_id, r.status, r.headers) for r in got.collect()}
    assert by == {
        2: (1, "resolved", {"content-length": "9", "etag": "e", "date": "d2", "cache-control": "a"}),
        3: (None, "no_response", None),
        4: (7, "resolved", {"etag": "f"}),
        5: (7, "no_validator", None),
        9: (7, "mismatch", None),
        11: (10, "resolved", {"etag": "q"}),
    }
    assert got.count() == 7


def test_revisits_repeated_headers_and_empty_tables(spark):
    schema = "record_id bigint, url string, ts bigint, kind string, headers map<string,string>"
    rows = [
        (1, "http://a.com/", 1, "response", {"ETag": "e", "etag": "e", "Vary": "a", "vary": "b", "VARY": None, "X": None, "x": None}),
        (2, "http://a.com/", 2, "revisit", {"ETag": "e", "Date": "1", "DATE": "2"}),
        (3, "http://a.com/" + "x" * 300_000, 2, "revisit", {"ETag": "e" * 300_000}),
    ]
    records = spark.createDataFrame(rows, schema)
    got = {r.record_id: (r.status, r.headers) for r in revisits.resolve(records).collect()}
    assert got == {2: ("resolved", {"etag": "e", "vary": "a, b", "x": None, "date": "1, 2"}), 3: ("no_response", None)}
    assert revisits.resolve(records.limit(0)).count() == 0
    pages = spark.createDataFrame([(None, "http://a.com", "h"), (1, None, None), (1, None, None)], "page_id bigint, url string, html string")
    assert revisits.captures(pages).count() == 9 and revisits.captures(pages.limit(0)).count() == 0
    revisits.resolve(revisits.captures(pages)).collect()


def test_captures_meet_across_pages_and_hours(spark):
    found = revisits.resolve(revisits.captures(table(spark, "/root/testdata/sf0.01", "pages"))).toPandas()
    assert set(found.status) == {"resolved", "mismatch", "no_validator", "no_response"}
    met = found.dropna(subset="response_id")
    assert (met.response_id // 3 != met.record_id // 3).sum() > 50  # another page's capture
    assert met.response_id.value_counts().max() > 2


# op9


def test_lookup_table():
    names = shard.names(7)
    out = shard.lookup(names, 1009)
    sizes = np.bincount(out, minlength=7)
    assert len(out) == 1009 and sizes.max() - sizes.min() <= 1
    fewer = shard.lookup(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(out, fewer, strict=True) if a != 6)
    assert moved < 0.2 * 1009
    # by the definition: whole permutations first, then turns
    orders = []
    for name in names:
        d = hashlib.sha256(name.encode()).digest()
        start, skip = int.from_bytes(d[:8], "big") % 1009, int.from_bytes(d[8:16], "big") % 1008 + 1
        orders.append([(start + j * skip) % 1009 for j in range(1009)])
    want, turn = {}, 0
    while len(want) < 1009:
        want[next(s for s in orders[turn % 7] if s not in want)] = turn % 7
        turn += 1
    assert out == [want[i] for i in range(1009)]
    for bad in (([], 7), (["a", "a"], 7), (["a"], 8)):
        with pytest.raises(ValueError):
            shard.lookup(*bad)


def test_placement(spark):
    docs = documents(spark, ODD, WIDE)
    got = shard.place(docs, "doc_id")
    assert got.count() == len(ODD) and got.columns == [*docs.columns, "slot_", "shard_"]
    assert got.groupBy("doc_id").agg(F.countDistinct("shard_").alias("n")).where("n > 1").count() == 0
    claims = shard.lookup(shard.names())
    for r in got.collect():
        slot = int(hashlib.md5(str(r.doc_id if r.doc_id is not None else "").encode()).hexdigest()[:15], 16) % shard.SLOTS
        assert (r.slot_, r.shard_) == (slot, f"shard-{claims[slot]:05d}")
    assert shard.place(docs.limit(0), "doc_id").count() == 0


# op10


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = toxicity.scores(table(spark, sf, "documents"), table(spark, sf, "labels")).join(table(spark, sf, "labels"), "doc_id").toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()
    held = got[got.held_out]
    assert (held.toxic == held.predicted).mean() > 0.98
    assert held[held.toxic == 1].predicted.mean() > 0.85 and held[held.toxic == 0].predicted.mean() < 0.01


def test_toxicity_odd_rows(spark):
    docs = documents(spark, ODD, WIDE)
    labels = spark.createDataFrame([(1, 1), (2, None), (4, 0), (5, 1), (5, 0), (None, 1)], "doc_id bigint, toxic int")
    got = toxicity.scores(docs, labels).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert all(r.predicted == 0 for r in toxicity.scores(docs, labels.limit(0)).collect())
    kept = toxicity.drop_toxic(docs, labels.limit(0))
    assert kept.columns == docs.columns and kept.count() == len(ODD)
    assert toxicity.scores(docs.limit(0), labels).count() == 0


def drawn(n, share, rates, copies, seed):
    """Classes and votes: voter i fires by its class's rate; each of `copies` repeats voter 0 nearly always."""
    r = np.random.RandomState(seed)
    y = (r.rand(n) < share).astype(int)
    votes = np.array([r.rand(n) < np.where(y == 1, hot, cold) for cold, hot in rates]).T.astype(float)
    same = [np.where(r.rand(n) < 0.02, r.rand(n) < 0.1, votes[:, 0]) for _ in range(copies)]
    return y, np.column_stack([votes, *same])


def test_label_model_finds_accuracies_and_dependence():
    rates = [(0.02, 0.5), (0.01, 0.3), (0.05, 0.4), (0.3, 0.3), (0.02, 0.6)]
    y, votes = drawn(6000, 0.2, rates, 3, 5)
    labels = np.where(np.arange(6000) < 600, y, -1)  # few labels; the rest of the rows only vote
    model = toxicity.label_model(votes, labels, 0.2)
    assert {0, 5, 6, 7} >= {model.parents[j] for j in (5, 6, 7)} and model.parents[3] == 3  # copies hang together, chance does not
    post = 1 / (1 + np.exp(-model.odds(votes)))
    alone = np.zeros((2, 8))
    alone[0, [0, 5, 6, 7]], alone[1, 0] = 1, 1
    p, q = 1 / (1 + np.exp(-model.odds(alone)))
    assert abs(p - q) < 0.25  # four copies are hardly surer than one
    true, found = (np.array([p @ votes[:, j] / votes[:, j].sum() for j in range(5)]) for p in (y, post))
    # The share of toxic rows where a voter fires. As abstaining counts for nothing it comes out a little high; calibration takes that back.
    assert (0 < found - true).all() and (found - true).max() < 0.2 and found.argsort()[:2].tolist() == true.argsort()[:2].tolist() == [3, 2]
    assert ((post > 0.5) == y).mean() > 0.9 and model.odds(np.zeros((1, 8)))[0] == pytest.approx(np.log(0.25))
    # the odds, a row and a voter at a time
    for v, got in zip(votes[:50], model.odds(votes[:50]), strict=True):
        want = np.log(0.25)
        for j, q in enumerate(model.parents):
            if v[j]:
                k = int(q != j and v[q] > 0)
                want += np.log(model.rates[1][k][j] / model.rates[0][k][j])
        assert got == pytest.approx(want)


def test_tree_is_the_maximum_spanning_one():
    from itertools import combinations

    r = np.random.RandomState(2)
    shared = r.rand(5, 5)
    shared += shared.T
    parents = toxicity.tree(shared, 0.0)
    got = sum(shared[j, q] for j, q in enumerate(parents) if j != q)

    def spans(edges):
        seen = {0}
        for _ in range(5):
            seen |= {b for e in edges for a, b in (e, e[::-1]) if a in seen}
        return len(seen) == 5

    assert got == pytest.approx(max(sum(shared[e] for e in edges) for edges in combinations(combinations(range(5), 2), 4) if spans(edges)))
    assert (toxicity.tree(shared, 99.0) == np.arange(5)).all()


def test_calibration_and_labels_as_votes():
    r = np.random.RandomState(4)
    odds = r.randn(5000) * 3
    truth = 1 / (1 + np.exp(-(0.5 * odds - 1)))
    labels = np.where(np.arange(5000) < 4000, (r.rand(5000) < truth).astype(int), -1)
    post = toxicity.calibrated(odds, labels)
    assert np.abs(post - truth).max() < 0.06
    after = toxicity.with_labels(post, labels)
    assert (after[labels < 0] == post[labels < 0]).all() and (after[labels == 1] >= post[labels == 1]).all() and (after[labels == 0] <= post[labels == 0]).all()


def test_scores_are_the_models_sums(spark, monkeypatch):
    import re

    docs = with_broken(documents(spark, ODD[:-3] + [(30, "idiot idiots Idiotic x1"), (31, "\u0130 \u00df STRASSE " * 30)]))
    r = random.Random(3)
    features = {f for t in ("idiot idiots idiotic", words(1, 60), "one straße") for w in t.split() for f in [w, *(f"{w[:n]}-" for n in range(3, 10) if n <= len(w))]}
    weights = {toxicity.code(f): r.uniform(-1, 1) for f in features} | {toxicity.again(toxicity.code("idi-")): 1.5}
    monkeypatch.setattr(toxicity, "fit", lambda *a, **k: toxicity.Model(-0.5, weights))
    got = sorted((r.doc_id or 0, r.score) for r in toxicity.scores(docs, None).collect())
    want = []
    for row in docs.select("doc_id", F.col("text").cast("binary").alias("raw")).collect():
        text, held = bytes(row.raw or b"").decode("utf-8", "replace"), []
        for w in {*re.findall(r"[^\W\d_]+", text.lower())}:
            held += [toxicity.code(f) for f in {w, *(f"{w[:n]}-" for n in range(3, 10) if n <= len(w))}]
        z = -0.5 + sum(weights.get(c, 0) for c in {*held}) + sum(weights.get(toxicity.again(c), 0) for c in {*held} if held.count(c) > 1)
        want.append((row.doc_id or 0, 1 / (1 + np.exp(-z))))
    assert [i for i, _ in got] == [i for i, _ in sorted(want)] and np.allclose([x for _, x in got], [x for _, x in sorted(want)])


def test_voters_are_reported_and_votes_counted(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    found = {r.voter: r for r in toxicity.voter_report(docs, labels).collect()}
    assert {*toxicity.LEXICONS, *toxicity.PATTERNS} <= {*found} and all(0 <= r.accuracy <= 1 and r.depends_on in found for r in found.values())
    assert found["stupidity"].accuracy > 0.9 and found["stupidity"].fires > 0
    rows, n = toxicity.sampled(docs, labels, toxicity.Limits(clean=50, toxic=20, documents=30), [])
    seen = rows.collect()
    assert len(seen) == len({r.doc_id for r in seen}) <= 100 and sum(r.label == 1 for r in seen) >= 15 and any(r.label is None for r in seen)
    assert not any(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in seen)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    names = [*toxicity.LEXICONS]
    for r in seen:
        said = set(toxicity.WORD.findall(texts[r.doc_id].lower()))
        assert [bool(x) for x in bytes(r.votes)[: len(names)]] == [bool(said & set(toxicity.LEXICONS[x].split())) for x in names]


# pipeline


def test_pipeline(spark):
    docs, before = table(spark, SF, "documents"), None
    for name, stage in corpus_pipeline.STAGES:
        out = common.materialize(stage(spark, docs, SF), name)
        before, ids = {r.doc_id for r in docs.select("doc_id").collect()}, {r.doc_id for r in out.select("doc_id").collect()}
        if name == "toxicity":
            bad = {r.doc_id for r in toxicity.scores(docs, table(spark, SF, "labels")).where("predicted = 1").collect()}
        elif name == "near_dedup":
            bad = {i for i, _, c in brute_components([(r.doc_id, r.text) for r in docs.collect()], 5, 80) if i != c}
        elif name == "decontamination":
            from test_decontaminate import brute

            items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
            texts = [(r.doc_id, r.text) for r in docs.collect()]
            bad = {r.doc_id for r in decontaminate.contaminated_pairs(docs, table(spark, SF, "benchmark")).collect()}
            some = [x for x in texts if x[0] in bad or x[0] % 10 == 0]  # brute force takes long; the whole table has SQL
            assert {k for k, *_ in brute(some, items)} == bad
        else:
            bad = set()
        assert ids == before - bad, name
        assert out.columns == docs.columns or name == "sharding"
        if name == "source_mixing":  # as often as `mixed` says, which SQL confirms, and in its order
            plan = mixing.mixed(docs).orderBy("block", "place").collect()
            assert [r.doc_id for r in stage(spark, docs, SF).select("doc_id").collect()] == [r.doc_id for r in plan]
        elif name == "sharding":
            claims = shard.lookup(shard.names())
            slots = {i: int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16) % shard.SLOTS for i in ids}
            assert {(r.doc_id, r.slot, r.shard) for r in out.collect()} == {(i, s, f"shard-{claims[s]:05d}") for i, s in slots.items()} and out.count() == docs.count()
        docs = out
    assert corpus_pipeline.run(spark, SF).count() == docs.count()


def test_pipeline_odd_rows(spark):
    """Nulls, blanks, long and broken texts, repeated rows, clashing columns, and an empty table, through every stage."""
    rows = with_broken(documents(spark, ODD, WIDE)).withColumnsRenamed({"band": "__digest", "score": "pass", "kept": "__kept_id"})
    docs, empty = common.materialize(rows, "odd"), common.materialize(rows.limit(0), "none")
    before = {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        docs = common.materialize(out, name)
        left = {r.doc_id for r in docs.collect()}
        assert left == before - ({5, 7} if name == "near_dedup" else set()), name
        before = left
        nothing = stage(spark, empty, SF)
        assert nothing.count() == 0 and nothing.columns == out.columns, name
        assert name == "sharding" or out.columns == rows.columns
        texts = {r.doc_id: r.text for r in docs.where("doc_id IN (1, 2, 8)").collect()}
        assert (texts[1], texts[2], texts[8]) == (None, "", ODD[9][1])


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracles(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    answer = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(repr(tuple(r[c] for c in names)) for r in df.collect()) == sorted(map(repr, answer.fetchall()))
