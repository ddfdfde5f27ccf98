"""Row-local operators and exact dedup against plain Python."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from textlab.llm import bpe, exact, near, packing, pages, quality, shards, urls
from textlab.llm.queries import QUERIES, URL_RULES, word_bpe


def collect(df):
    return [r.asDict() for r in df.collect()]


def test_exact_dedup(documents, no_documents):
    found = exact.exact_dedup(documents)
    assert found.schema["kept"].dataType.simpleString() == "boolean" and {"lang", "bucket"} <= set(found.columns)
    rows = collect(found.select("doc_id", "keep_id", "group_size", "kept", F.hex("text_digest").alias("d"), "text"))
    assert len(rows) == documents.count()
    groups = {}
    for r in rows:
        folded = (r["text"] or "").encode().lower()
        assert r["d"].lower() == hashlib.sha256(folded).hexdigest()
        groups.setdefault(folded, []).append(r)
    for members in groups.values():
        ids = [r["doc_id"] for r in members if r["doc_id"] is not None]
        assert {r["keep_id"] for r in members} == {max(ids, default=None)}
        assert {r["group_size"] for r in members} == {len(members)}
        assert sum(r["kept"] for r in members) == 1
    assert exact.exact_dedup(no_documents).count() == 0


@pytest.mark.parametrize("arrived", ["true", "false", "doc_id % 2 = 0"])
def test_exact_dedup_for_any_history(documents, arrived):
    want = sorted(map(str, collect(exact.exact_dedup(documents).select("doc_id", "keep_id", "group_size", "kept"))))
    got = exact.exact_dedup(documents, arrived=F.coalesce(F.expr(arrived), F.lit(False)), keys_per_bucket=3)
    assert sorted(map(str, collect(got.select("doc_id", "keep_id", "group_size", "kept")))) == want


def test_perfect_hash_is_minimal_and_rejects_strangers():
    digests = [hashlib.sha256(str(i).encode()).digest() for i in range(5000)]
    words = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 4)
    made = exact.PerfectHash.build(words)
    assert sorted(made.slots(words)) == list(range(5000))
    full = np.empty_like(words)
    full[made.slots(words)] = words
    other = np.frombuffer(b"".join(hashlib.sha256(f"o{i}".encode()).digest() for i in range(2000)), "<u8").reshape(-1, 4)
    at = made.slots(other)
    assert not ((at >= 0) & (full[at] == other).all(axis=1)).any()


def test_external_shuffle(documents, no_documents):
    made = shards.external_shuffle(documents, 3, bucket_bytes=4000)
    rows = collect(made)
    assert sorted(str((r["doc_id"], r["text"])) for r in rows) == sorted(str((r["doc_id"], r["text"])) for r in documents.collect())
    sizes = [sum(r["shard"] == s for r in rows) for s in range(3)]
    assert max(sizes) - min(sizes) <= 1
    for s in range(3):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sizes[s]))
    place = lambda df: sorted((str(r["doc_id"]), str(r["text"]), r["shard"], r["slot"]) for r in df.collect())
    assert place(made) == place(shards.external_shuffle(documents.repartition(5), 3, bucket_bytes=4000))
    assert place(made) != place(shards.external_shuffle(documents, 3, seed=1, bucket_bytes=4000))
    assert shards.external_shuffle(no_documents, 3).count() == 0


def test_external_shuffle_equals_a_plain_one(documents):
    whole = collect(documents.drop("shard"))
    buckets = shards.blocks_for(sum(len((r["text"] or "").encode()) + 1 for r in whole), 4000)
    placed = collect(shards.scattered(documents.drop("shard"), buckets, 17, "b", "m"))
    order = []
    for b in range(buckets):
        some = sorted((r for r in placed if r["b"] == b), key=lambda r: ((r["doc_id"] is None, r["doc_id"] or 0), (r["text"] is None, r["text"] or ""), r["m"]))
        turn = np.arange(len(some))
        np.random.Generator(np.random.PCG64([17, b])).shuffle(turn)
        order += [some[i] for i in turn]
    assert buckets > 2
    cut = [i * len(order) // 3 for i in range(4)]
    want = [(r["doc_id"], r["text"], s, i - cut[s]) for s in range(3) for i, r in enumerate(order) if cut[s] <= i < cut[s + 1]]
    got = [(r["doc_id"], r["text"], r["shard"], r["slot"]) for r in collect(shards.external_shuffle(documents, 3, bucket_bytes=4000))]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_rows_of_one_id_are_spread(spark):
    one_id = spark.range(20_000).select(F.lit(1).alias("doc_id"), F.concat(F.lit("t"), F.col("id")).alias("text"))
    one_text = spark.range(20_000).select("id", F.lit(1).alias("doc_id"), F.lit("same text").alias("text"))
    for rows in (one_id, one_text):
        sizes = [r["count"] for r in shards.scattered(rows, 40, 17, "b", "m").groupBy("b").count().collect()]
        assert len(sizes) == 40 and max(sizes) < 700
        made = shards.external_shuffle(rows, 4, bucket_bytes=4000)
        assert {r["count"] for r in made.groupBy("shard").count().collect()} == {5000}


def test_names_of_the_caller_survive(spark, documents):
    labels = spark.createDataFrame([(1, 1), (2, 1), (6, 1)], "doc_id long, quality int")
    names = ["__bucket", "__mark", "__salt", "__turn", "__new", "__score", "__text_hash", "__id", "__hash", "mark", "rows", "start", "count",
             "salt", "turn", "new", "score", "kept_id", "kept_hash"]
    own = documents.drop("kept", "shard", "bucket").where("doc_id IS NOT NULL")
    for n in names:
        own = own.withColumn(n, F.concat(F.lit(n), F.col("doc_id")))
    made = [
        shards.external_shuffle(own, 2, bucket_bytes=4000), exact.exact_dedup(own), near.keep_one(own),
        quality.keep_good(own, labels), quality.weighted(own, quality.fit(own, labels)),
    ]
    for df in made:
        rows = collect(df)
        assert rows and all(r[n] == f"{n}{r['doc_id']}" for r in rows for n in names)


def test_shards_are_written(documents, tmp_path):
    shards.write_shards(documents.select("doc_id", "text"), str(tmp_path / "out"), 2)
    assert documents.sparkSession.read.parquet(str(tmp_path / "out")).groupBy("shard").count().count() == 2


def judge_plainly(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min((i for i in (path.find(c) for c in "?#") if i >= 0), default=len(path))]
    best = None
    for rule in ("com/", "example.com/en/", "www.example.com/en/", "net/es/", "net/fr/"):
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best)):
            best = rule
    return host, path, best


def test_url_filter(spark):
    listed = [
        None, "", "no scheme", "http://", "http://WWW.Example.COM/en/1", "http://example.com/en/", "http://example.com/en",
        "https://a.b.net/es/x?y", "https://net/fr/", "https://xnet/fr/", "http://x.net/de/", "http://free-bets.example.org/1",
        "http://example.com?x=/en/", "http://casino.example.com/en/1", "ftp://a://b/c", "http://a.com:80/x", "http://x.org/\n/y#z",
        "http://my-casino-win.org/", "http://casinos.org/",
    ]
    pages_ = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(listed)], "page_id long, url string, host string")
    verdicts = {r.name: r.verdict for r in URL_RULES}
    for r in urls.filter_urls(pages_, URL_RULES).collect():
        host, path, rule = judge_plainly(listed[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdicts[rule] if rule else ("block" if r["pattern"] else "allow"))
    found = {r["page_id"]: r["pattern"] for r in urls.filter_urls(pages_, URL_RULES).collect()}
    assert found[11] == "free bets" and found[13] == "casino" and found[17] == "casino" and found[18] is None
    assert urls.filter_urls(pages_.where("false"), URL_RULES).count() == 0


def test_rules_are_filed_under_their_rarest_token():
    index = urls.RuleIndex([urls.host_rule("example.com", "/en/", "block")], {"example": 90, "com": 50, "en": 70})
    assert list(index.by_token) == ["com"]
    assert urls.RuleIndex([urls.Rule("x+", "block", (), "x")], {}).judge("axxb", "/")[1] == "x"


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="<p>no</p>";</script></head>
<body class="has-sidebar"><header><h2>Site name</h2></header><nav><ul><li><a href="/a">Menu</a></ul></nav>
<div class="cookie-notice">We use cookies on this site and the others that are ours, for the good of all.</div>
<article><header><h1>The title &amp; more</h1></header><p>The first&nbsp;part of the text is about
  the <b>way</b> that it was and that is all there is to say about it here.<br>Next line.
<div class="ad">Buy this</div><p>Short.<form><input> Send it to me</form>
<p>See <a href="/x">this link here</a> for the rest of the things that we have, which is what it was all about.</p>
<ul class="related"><li><a>One</a></ul></article><aside>On the side</aside>
<section id="comments"><p>I think that this is the best of all the things that I have read in all of the days.</p></section>
<footer>&copy; us</footer></body></html>"""


def test_page_text():
    assert pages.main_text(PAGE).split("\n") == [
        "The title & more",
        "The first part of the text is about the way that it was and that is all there is to say about it here. Next line.",
        "Short.",
        "See this link here for the rest of the things that we have, which is what it was all about.",
    ]
    long = "The one of the two is that which it was and not the other that was with it. " * 4
    plain = f"<body><ul><li><a>Home</a><li><a>About</a></ul><p>{long}</p><p>Short too.</p><p>{long}</p><p><a>More to see</a></p>"
    assert pages.main_text(plain).split("\n") == [long.strip(), "Short too.", long.strip()]
    assert pages.main_text("<article>Only this</article>") == "Only this"
    middling = "Words of kinds that nobody lists, and still the same sort of text that a page is made of, so to say it once more here."
    assert pages.main_text(f"<nav><a>Home</a></nav><h1>Head</h1><p>{middling}</p><div class='footer'>Foot</div>") == f"Head\n{middling}"
    for odd in (None, "", "   ", "<", "<p", "<a href='", "<!-- open", "<script>x", "&amp &#x; &bogus;", "</p></div></p>", "<p" * 2000):
        assert isinstance(pages.main_text(odd), str)


def test_page_text_in_other_languages():
    """Pages without an article in languages whose stop words are not listed, and technical passages."""
    texts = [
        "Gli abitanti della valle hanno sempre coltivato gli stessi campi, e ogni anno, quando arriva la primavera, tornano sui sentieri "
        "che portano ai pascoli alti. Nessuno ricorda quando sia cominciata questa usanza, ma tutti vi partecipano volentieri da bambini.",
        "Mieszkańcy doliny zawsze uprawiali te same pola i każdego roku, gdy nadchodzi wiosna, wracają na ścieżki prowadzące na wysokie "
        "pastwiska. Nikt już nie pamięta, kiedy zaczął się ten zwyczaj, ale wszyscy chętnie biorą w nim udział od wczesnego dzieciństwa.",
        "Жители долины всегда возделывали одни и те же поля, и каждый год, когда приходит весна, они возвращаются на тропы, ведущие к "
        "высоким пастбищам. Никто не помнит, когда начался этот обычай, но все охотно участвуют в нём с самого раннего детства.",
        "山谷里的居民一直耕种着同样的田地，每年春天来临的时候，他们都会沿着小路回到高山牧场。没有人记得这个习俗是什么时候开始的，但大家都很乐意参加。",
    ]
    for text in texts:
        page = f"<body><ul><li><a>Home</a><li><a>About</a></ul><div><p>{text}</p><p>{text}</p></div><div class='footer'>Foot</div></body>"
        assert pages.main_text(page) == f"{text}\n{text}"
    prose = "The one of the two is that which it was and not the other that was with it. " * 4
    table = "Width 40 mm, height 25 mm, depth 12 mm, weight 310 g, voltage 230 V, current 2 A, fuse 3 A, colour grey, housing steel. " * 3
    assert pages.main_text(f"<p>{prose}</p><p>{table}</p><p>{prose}</p>").split("\n") == [prose.strip(), table.strip(), prose.strip()]


@pytest.mark.parametrize("odd", [
    '<svg class="i"/>', "<svg>", "<iframe src='x'/>", "<object/>", "<title-bar>", "<select-menu>", "<iframe src=x>", "<template>",
    "<svg><path/></svg>", "<svg><svg></svg>inner</svg>", "<iframe src=http://x/></iframe>", "<svg title='>'/>", "<SVG\n/>", "<canvas><p>not shown</p></canvas >",
])
def test_hidden_elements_end(odd):
    assert pages.main_text(f"<article><p>a</p>{odd}<p>b</p></article>") == "a\nb"
    assert pages.main_text(f"<article><p>a</p>{odd}<p>b</p><svg>x</svg><p>c</p></article>") == "a\nb\nc"


def test_text_inside_a_form():
    prose = "The one of the two is that which it was and not the other that was with it. " * 4
    assert pages.main_text("<form id='aspnetForm'><article><p>Only this</p></article></form>") == "Only this"
    page = f"<body><form method=post><nav><a>Menu</a></nav><h1>Head</h1><p>{prose}</p><p>End.</p></form><form><input> Send it</form></body>"
    assert pages.main_text(page) == f"Head\n{prose.strip()}\nEnd."


def test_pages_query_columns(spark):
    table = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "y")], "page_id long, url string, html string, text string")
    rows = {r["page_id"]: r for r in pages.extract_pages(table).collect()}
    assert rows[1]["text"] == pages.main_text(PAGE) and rows[2]["text"] == "" and rows[2]["url"] is None
    assert pages.extract_pages(table.where("false")).count() == 0


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(word_bpe())


def odd_texts():
    random.seed(5)
    letters = "abthe in'sré ßI<|>.,!?12 \t\n\x1c\xa0é́ſKΣ日😀İﬁǅ-"
    made = ["".join(random.choices(letters, k=random.randint(0, 40))) for _ in range(400)]
    return made + ["", "<|endoftext|>x<|startoftext|>", "a" * 700, "ab" * 600, "aaa" * 5, "don't we'll 'S", "a\x1cb\x85c", "x" * 300 + "é"]


def test_bpe_equals_library(tokenizer):
    encoder = bpe.TrieEncoder(bpe.definition_of(word_bpe()))
    texts = odd_texts()
    made = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert encoder.encode_batch(texts) == [np.array(i, "<u4").tobytes() for i in made]
    assert encoder.decode_batch([np.array(i, "<u4").tobytes() for i in made]) == [tokenizer.decode(i, skip_special_tokens=False) for i in made]
    library = packing.LibraryEncoder(bpe.definition_of(word_bpe()))
    assert packed_ids(library, texts) == [np.array(i, "<u4").tobytes() for i in made]
    assert packed_ids(library, [None, ""]) == [b"", b""] and packed_ids(library, []) == []


def packed_ids(library, texts):
    import pyarrow as pa

    data, at = library.encode(pa.array(texts, pa.string()))
    return [bytes(memoryview(data)[a:b]) for a, b in zip(at.tolist(), at[1:].tolist())]


def test_forgetting_changes_nothing(tokenizer, monkeypatch):
    for name in ("KNOWN_CHUNKS", "KNOWN_WORDS", "KNOWN_PAIRS"):
        monkeypatch.setattr(bpe, name, 5)
    monkeypatch.setattr(packing, "KNOWN_WORDS", 5)
    texts = odd_texts()[:60]
    want = [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    encoder, library = bpe.TrieEncoder(bpe.definition_of(word_bpe())), packing.LibraryEncoder(bpe.definition_of(word_bpe()))
    assert [encoder.encode_batch([t])[0] for t in texts] == want
    for _ in range(2):
        assert [packed_ids(library, [t])[0] for t in texts] == want
        library.words.rest(3)


def test_bpe_frames(documents, no_documents, tokenizer):
    rows = collect(bpe.encode(documents.withColumn("ids", F.lit(1)), word_bpe(), decoded=True))
    assert sorted(str((r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist())) for r in rows) == sorted(
        str((r["doc_id"], tokenizer.encode(r["text"] or "", add_special_tokens=False).ids)) for r in documents.collect()
    )
    again = bpe.decode(bpe.encode(documents, word_bpe()), word_bpe())
    assert sorted(str((r["doc_id"], r["decoded"])) for r in rows) == sorted(str((r["doc_id"], r["decoded"])) for r in collect(again))
    assert bpe.encode(no_documents, word_bpe()).count() == 0


def test_packing(documents, no_documents, tokenizer):
    rows = collect(packing.pack_documents(documents, word_bpe(), size=64))
    texts = {}
    for r in documents.collect():
        texts.setdefault(r["doc_id"], []).append(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [2])
    for doc, versions in texts.items():
        for ids in {tuple(v) for v in versions}:
            mine = sorted((r["start"], r["length"], r["ids_crc32"]) for r in rows if r["doc_id"] == doc and r["doc_tokens"] == len(ids))
            want = [(a, len(ids[a : a + 64]), zlib.crc32(np.array(ids[a : a + 64], "<u4").tobytes())) for a in range(0, len(ids), 64)]
            assert mine == sorted(want * sum(tuple(v) == ids for v in versions))
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(sequences) == list(range(len(sequences)))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack_documents(no_documents, word_bpe()).count() == 0


def test_shortest_pack_first():
    made = packing.pack_histogram({6: 2, 3: 3, 1: 5}, 10)
    # Two packs of 6; 3 goes to each (9 and 9), the third starts a pack; ones fill the shortest first.
    assert made.sequences == 3
    assert made.length.tolist() == [1] * 5 + [3, 3, 6] and made.offset.tolist() == [3, 4, 5, 6, 7, 6, 0, 0]
    many = packing.pack_histogram({n: 10**9 for n in range(1, 4097)}, 4096)
    assert len(many.length) < 100_000
    assert sum(n * 10**9 for n in range(1, 4097)) / (many.sequences * 4096) > 0.95


def test_registered_columns(spark, sf_dir):
    assert {"op1_substring_dedup", "op2_quality_classifier", "op3_url_filter", "op4_near_dedup", "op5_bpe_round_trip"} <= set(QUERIES)
    assert {"op6_external_shuffle", "op7_nearest_vectors", "op8_page_text", "op9_exact_dedup", "op10_packing"} <= set(QUERIES)


def test_packs_equal_a_loop_over_pieces():
    """Shortest pack first, one piece after the other: the same fill of every sequence as by counted patterns."""
    draw = random.Random(4)
    for size, n in ((64, 300), (4096, 2000), (7, 50), (4096, 0)):
        lengths = [min(size, 1 + int(draw.expovariate(6 / size))) if draw.random() < 0.7 else size // 3 + 1 for _ in range(n)]
        packs: list[int] = []
        for length in sorted(lengths, reverse=True):
            at = min(range(len(packs)), key=lambda i: (packs[i], i), default=None)
            if at is not None and packs[at] + length <= size:
                packs[at] += length
            else:
                packs.append(length)
        counts = {k: lengths.count(k) for k in set(lengths)}
        made = packing.pack_histogram(counts, size)
        fill = [0] * made.sequences
        runs = sorted(zip(made.length.tolist(), made.start.tolist(), made.first.tolist(), made.offset.tolist()))
        for i, (length, start, first, offset) in enumerate(runs):
            end = runs[i + 1][1] if i + 1 < len(runs) and runs[i + 1][0] == length else counts[length]
            for sequence in range(first, first + end - start):
                assert offset + length <= size
                fill[sequence] += length
        assert sorted(fill) == sorted(packs)
