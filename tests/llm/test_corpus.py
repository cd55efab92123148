"""Operators 1, 3, 4, 5, 6, 8 and 9 and the pipeline, against brute force and SQL."""

import hashlib
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from fleetlens.llm import bagminhash, components, linefreq, queries, quotes, rules, subwords, suffixes, urls

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def windows(items):
    out = {}
    for key, text in items:
        w = words(text)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            out.setdefault(tuple(w[k : k + n]), set()).add(key)
    return out


def brute_hits(text, known):
    w, hit, items = words(text), set(), set()
    for n in {len(k) for k in known}:
        for k in range(len(w) - n + 1):
            if found := known.get(tuple(w[k : k + n])):
                items |= found
                hit.update(range(k, k + n))
    return len(w), len(hit), items


def brute_classes(texts):
    """{id: least id} of the classes of 0.8-similar multisets of five-word shingles."""

    def bag(text):
        w = words(text)
        n = min(5, len(w))
        return Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if w else Counter({text or "": 1})

    bags = {k: bag(t) for k, t in texts.items()}
    root = {k: k for k in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(texts)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = sum((bags[a] & bags[b]).values())
            if 10 * both >= 8 * sum((bags[a] | bags[b]).values()):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in keys}


@pytest.fixture(scope="module")
def benchmark_items(small):
    table = pq.read_table(f"{small}/benchmark.parquet").to_pydict()
    return list(zip(table["item_id"], table["text"], strict=True))


def test_decontamination(spark, small, documents, benchmark_items):
    known = windows(benchmark_items)
    for r in queries.op1_decontamination(spark, small).collect():
        n, hit, items = brute_hits(documents[r.doc_id], known)
        names = ",".join(sorted(map(str, items)))
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, hit, len(items), hit > 0)
        assert r.items_sha256 == hashlib.sha256(names.encode()).hexdigest()


def test_suffix_array_is_sorted():
    texts = [b"a b a b a b a", b"", b"b a b a c", None, b"a b a b a b a"]
    array = suffixes.SuffixArray(texts, 8)
    keys = [tuple(array.text[s : s + 8]) for s in array.suffixes]
    full = [k[: k.index(0) + 1] if 0 in k else k for k in keys]
    assert full == sorted(full)
    block = suffixes.query_block([("x", "b a b a"), ("y", "c"), ("z", None)], 2)
    longest, low, high = array.find(block["words"], block["lengths"], block["starts"], block["stops"])
    assert longest.tolist() == [4, 3, 2, 1, 1]
    assert (high - low).tolist() == [8, 7, 8, 0, 1]


def test_stages_keep_columns_of_any_name(spark, small):
    """Dotted and clashing names pass through every stage of the pipeline that returns documents."""
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(40)
    more = {"a.b": "lang", "Ledger": "doc_id", "row": "doc_id", "key": "lang", "bits": "n_chars", "words": "lang", "c0": "doc_id"}
    odd = docs.select("*", *(docs[c].alias(n) for n, c in more.items()))
    for name, stage in corpus_pipeline.STAGES[:4]:
        kept = stage(spark, odd, small)
        assert kept.columns == odd.columns, name
        rows = [r.asDict() for r in kept.collect()]
        assert all(r[n] == r[c] for r in rows for n, c in more.items()), name


def test_decontamination_of_odd_rows(spark, odd):
    items = spark.createDataFrame([(7, "ring of the"), (8, None), (9, "")], "item_id long, text string")
    found = suffixes.clean(odd, items)
    assert found.columns == odd.columns and found.count() == 5
    assert suffixes.clean(odd, items.where("false")).count() == 6
    assert suffixes.clean(odd.where("false"), items).count() == 0


def brute_longest(text, items):
    """(longest, at_word) of the verbatim matches of a window or more."""
    w, best = words(text), (0, 1)
    for _, item in items:
        v = words(item)
        for p in range(len(w)):
            for q in range(len(v)):
                n = 0
                while p + n < len(w) and q + n < len(v) and w[p + n] == v[q + n]:
                    n += 1
                if n >= min(10, len(v)):
                    best = max(best, (n, -p))
    return (best[0], -best[1])


def test_longest_match_is_of_the_text_itself():
    item = [f"w{k}" for k in range(40)]
    items = [("a", " ".join(item)), ("b", " ".join(item[5:17] + ["else"] * 3)), ("c", "two words"), ("d", " ".join(f"x{k % 3}" for k in range(30)))]
    own = [f"v{k}" for k in range(9)]
    texts = [
        " ".join(own + item + own),  # the whole item
        " ".join(own[:4] + item[3:13] + own),  # ten words of it
        " ".join(item[20:33] + own + item[:11] + own + item[20:33]),
        " ".join(item[:9] + own),
        "",
        None,
        " ".join(["two", "words", "and", "two", "words"]),
        " ".join(own[:3] + [f"x{k % 3}" for k in range(25)] + own[:2] + [f"x{k % 3}" for k in range(1, 28)]),
        " ".join(own + item[5:17] + ["else"]),
    ]
    expected = [brute_longest(t, items) for t in texts]
    assert expected[:4] == [(40, 9), (10, 4), (13, 0), (0, -1)]
    for blocks in ([items], [items[:1], items[1:]], [items[::-1]]):
        found = suffixes.judge([t and t.encode() for t in texts], [suffixes.query_block(b, 10) for b in blocks])
        assert list(zip(found["longest"], found["at_word"], strict=True)) == expected
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 2, 60)) for _ in range(8)]
    items = [(k, " ".join(f"w{x}" for x in rng.integers(0, 2, 20))) for k in range(12)]
    found = suffixes.judge([t.encode() for t in texts], [suffixes.query_block(items, 10)])
    assert list(zip(found["longest"], found["at_word"], strict=True)) == [brute_longest(t, items) for t in texts]


def test_near_duplicates(spark, small, documents):
    expected = brute_classes(documents)
    found = {r.doc_id: r.class_id for r in queries.op4_near_duplicates(spark, small).collect()}
    assert found == expected


def test_signature_estimate_is_unbiased():
    rng = np.random.default_rng(3)
    shares = []
    for _ in range(40):
        a = [f"w{x}" for x in rng.integers(0, 60, 300)] * 2
        b = a[:500] + [f"v{x}" for x in rng.integers(0, 60, 100)]
        owner, value, count = bagminhash.shingles([" ".join(a).encode(), " ".join(b).encode()])
        first, second = (dict(zip(value[owner == k], count[owner == k], strict=True)) for k in (0, 1))
        keys = first.keys() | second.keys()
        true = sum(min(first.get(k, 0), second.get(k, 0)) for k in keys) / sum(max(first.get(k, 0), second.get(k, 0)) for k in keys)
        sign = bagminhash.signatures(owner, value, count, 2)
        shares.append((sign[0] == sign[1]).mean() - true)
    assert abs(np.mean(shares)) < 0.02


def test_near_duplicates_around_a_common_passage(spark):
    rng = np.random.default_rng(11)
    passage = [f"p{x}" for x in range(60)]
    rows = []
    for k in range(120):
        own = [f"w{x}" for x in rng.integers(0, 5000, 40)]
        rows.append((2 * k, " ".join(own[:20] + passage + own[20:])))
        if k % 3 == 0:  # a copy with another last word
            rows.append((2 * k + 1, " ".join(own[:20] + passage + own[20:39] + ["else"])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.class_id for r in bagminhash.report(docs).collect()}
    assert found == {key: key - key % 2 for key, _ in rows}


def test_rare_pairs_find_every_similar_pair(spark):
    """All similar pairs of different classes, in a crowd that shares a passage and a large class."""
    draw = np.random.default_rng(4)
    passage = draw.integers(0, 1 << 60, 60)
    sets = [np.concatenate([passage[: draw.integers(20, 60)], draw.integers(0, 1 << 60, draw.integers(5, 60))]) for _ in range(120)]
    for k in range(0, 60, 2):  # neighbours at similarities around 0.8
        other, new = sets[k].copy(), int(len(sets[k]) * draw.uniform(0.05, 0.16))
        other[:new] = draw.integers(0, 1 << 60, new)
        sets.append(other)
    big = draw.integers(0, 1 << 60, 50)
    sets += [np.concatenate([big, draw.integers(0, 1 << 60, 3)]) for _ in range(80)]
    sets += [np.concatenate([big, draw.integers(0, 1 << 60, m)]) for m in (5, 12, 13, 40)]
    sets = [np.unique(x) for x in sets]
    classes = [k if not 150 <= k < 230 else 150 for k in range(len(sets))]
    rows = [(k, len(x), classes[k], bytearray(x.astype(np.int64).tobytes())) for k, x in enumerate(sets)]
    nodes = spark.createDataFrame(rows, "node long, size long, class long, bag binary").repartition(5)
    found = {(r.a, r.b) for r in bagminhash.rare_pairs(nodes, 0.8).collect()}
    both = lambda x, y: len(np.intersect1d(x, y))
    similar = {
        (a, b)
        for b in range(len(sets))
        for a in range(b)
        if classes[a] != classes[b] and 10 * both(sets[a], sets[b]) >= 8 * (len(sets[a]) + len(sets[b]) - both(sets[a], sets[b]))
    }
    assert len(similar) > 80
    assert similar <= found
    assert len(found) < len(sets) ** 2 / 20
    kept = {(r.a, r.b) for r in bagminhash.verified(bagminhash.rare_pairs(nodes, 0.8), nodes.select("node", "bag"), 0.8).collect()}
    assert kept == similar


def test_a_crowd_of_near_copies_needs_few_pairs(spark):
    """Pairwise just below the similarity: bounds rule most pairs out; similar ones stay, and central ones are among them."""
    draw = np.random.default_rng(8)
    base, sets = draw.integers(0, 1 << 60, 150), []
    for k in range(200):
        own = draw.integers(2, 8) if k % 20 == 0 else draw.integers(12, 16)
        held = base.copy()
        held[draw.choice(150, own, replace=False)] = draw.integers(0, 1 << 60, own)
        sets.append(np.unique(held))
    rows = [(k, len(x), k, bytearray(x.astype(np.int64).tobytes())) for k, x in enumerate(sets)]
    nodes = spark.createDataFrame(rows, "node long, size long, class long, bag binary").repartition(5)
    found = [(r.a, r.b) for r in bagminhash.rare_pairs(nodes, 0.8).collect()]
    both = {(a, b): len(np.intersect1d(sets[a], sets[b])) for b in range(len(sets)) for a in range(b)}
    similar = {(a, b) for (a, b), n in both.items() if 10 * n >= 8 * (len(sets[a]) + len(sets[b]) - n)}
    assert similar and similar <= set(found)
    assert len(found) == len(set(found)) < len(both) / 4
    central = {(r.a, r.b) for r in bagminhash.central_pairs(bagminhash.ranked(nodes, 0.8), 0.8).collect()}
    assert central <= set(found) and len(central) < 10 * len(sets) and central & similar


def test_near_duplicates_of_odd_rows(spark, odd):
    kept = bagminhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id or 0) for r in kept.select("doc_id").collect()) == [0, 1, 3, 4]
    assert bagminhash.keep_one(odd.where("false")).count() == 0


def test_one_text_of_a_key_stays_in_each_class(spark):
    base = [f"w{k}" for k in range(80)]
    near = [" ".join([*base[:-1], end]) for end in ("one", "two", "three")]
    rows = [(1, near[0]), (1, near[1]), (1, near[1]), (2, near[2]), (1, " ".join(f"v{k}" for k in range(60))), (3, "else")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [(r.doc_id, r.text) for r in bagminhash.keep_one(docs).collect()]
    assert sorted(k for k, _ in kept) == [1, 1, 3] and rows[4] in kept and sum(t in near[:2] for _, t in kept) == 1


def test_components(spark):
    links = [(k, k + 1) for k in range(30)] + [(100, 101), (103, 101), (200, 200)]
    found = {r.node: r["class"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {found[k] for k in range(31)} == {0} and found[103] == found[101] == found[100] == 100


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, small, name):
    with duckdb.connect() as db:
        for table in ("documents", "conversations", "pages"):
            db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{small}/{table}.parquet'")
        expected = db.execute(queries.oracle_sql()[name]).fetchall()
        columns = [d[0] for d in db.description]
    found = [tuple(r[c] for c in columns) for r in queries.queries()[name](spark, small).collect()]
    assert sorted(found, key=repr) == sorted(expected, key=repr)


def test_rules_ablation(spark, odd):
    ledger = rules.measured(odd)
    assert rules.keep(odd).count() == 0 and rules.keep(odd).columns == odd.columns
    found = {r.rule: (r.n_docs, r.n_failed, r.n_alone) for r in rules.ablation(ledger, rules.BASE).collect()}
    assert found == {"few_words": (6, 4, 4), "repeated_words": (6, 2, 2)}
    m = ledger.where("doc_id = 3").first().ledger
    assert (m.n_words, m.n_repeat_words) == (21000, 21000)


def test_lines(spark):
    rows = [(k, f"menu\nown {k}\n\nmenu ", "h") for k in range(20)] + [(90, None, "h"), (91, "menu", None), (92, "", "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {r.doc_id: r.text for r in linefreq.clean(docs).collect()}
    assert found[3] == "own 3\n" and found[90] is None and found[91] == "menu" and found[92] == ""
    assert linefreq.clean(docs.where("false")).count() == 0


def test_copies_are_no_boilerplate(spark):
    copied = {c: "\n".join(f"{c} line {k} " + " ".join(f"{c}{k}{x}" for x in "pqrstuvw") for k in range(4)) for c in ("ant", "bee")}
    rows = [(k, f"menu\nown {k}", "h") for k in range(20)]
    rows += [(100 + k, copied["ant"], "h") for k in range(12)] + [(200 + k, copied["bee"], "h") for k in range(6)]
    rows += [(300, "ant line 0 " + " ".join(f"ant0{x}" for x in "pqrstuvw") + "\nanother page", "h"), (301, "menu\n", "h")]
    rows += [(400 + k, copied["ant"], None) for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    cleaned = linefreq.clean(docs)
    found = {r.doc_id: r.text for r in cleaned.collect()}
    given = {k: t for k, t, _ in rows}
    assert found == {k: f"own {k}" if k < 20 else given[k] for k in given}
    kept = {r.doc_id for r in bagminhash.keep_one(cleaned).collect()}
    assert {100, 200, 300, 301} <= kept and not kept & {101, 201, 400}


def test_quality_is_learned(spark, odd):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    found = [r for r in queries.op3_quality_classifier(spark, sf).collect() if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in found]) > 0.9
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in subwords.classify(odd, subwords.fit(odd, none)).collect()} == {0.5}


def test_training_reads_a_staged_sample(spark):
    rows = [(k, f"text {k} {copy}") for k in range(40) for copy in range(30 if k < 9 else 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    some = subwords.sample(docs, labels, "quality", "doc_id", "text", 6)
    found = [r.key for r in some.collect()]
    assert len(found) == 12 and len(set(found)) == 12
    assert "Join" not in some._jdf.queryExecution().toString()  # else the training task reads all documents
    assert sorted(some.collect()) == sorted(subwords.sample(docs.orderBy("text"), labels, "quality", "doc_id", "text", 6).collect())
    assert len(subwords.fit(docs, labels)) == subwords.BUCKETS


def test_urls(spark):
    given = [
        ("http://A.Example.NET/en/x", "a.example.net", "/en/x", "example.net/en/", "allow"),
        ("https://x.net/y?z", "x.net", "/y", "net/", "block"),
        ("https://notnet/y", "notnet", "/y", None, "allow"),
        ("https://example.com/de/#t", "example.com", "/de/", "example.com/de/", "block"),
        ("https://b.org/fr/", "b.org", "/fr/", "org/fr/", "allow"),
        ("https://b.org?fr", "b.org", "", None, "allow"),
        ("nothing", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("", "", "", None, "allow"),
    ]
    pages = spark.createDataFrame([(k, g[0], None, k) for k, g in enumerate(given)], "page_id long, url string, html string, host long")
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages).collect()}
    assert found == {k: g[1:] for k, g in enumerate(given)}
    assert urls.judge(pages.where("false")).count() == 0
    assert urls.Segmenter({"ring": 5, "the": 9, "thering": 1}).split("theringxx") == ["the", "ring", "xx"]  # one unknown word is likelier than two


def test_every_title_word_is_known(spark):
    long = "donaudampfschifffahrtsgesellschaft"
    title = " ".join(f"q{k}q q{k}q" for k in range(50_010)) + f" ring bell {long}"
    pages = spark.createDataFrame([(1, f"<title>{title}</title>")], "page_id long, html string")
    shapes = spark.createDataFrame([("ringbell.org", f"/x{long}bell/zz0"), ("", "/ringbell/0")], "host string, shape string")
    counts = urls.unigrams(pages)
    assert counts.count() == 50_013 + len(urls.BLOCKED_WORDS)
    found = sorted((r.host, r.words) for r in urls.words_of(shapes, counts).collect())
    assert found == [("", ["ring", "bell"]), ("ringbell.org", ["org"]), ("ringbell.org", ["ring", "bell"]), ("ringbell.org", ["x", long, "bell"]), ("ringbell.org", ["zz0"])]


def test_segments_are_the_likeliest():
    rng = np.random.default_rng(2)
    for _ in range(40):
        counts = {"".join(rng.choice(list("ab"), rng.integers(1, 5))): int(rng.integers(1, 9)) for _ in range(6)}
        text, model = "".join(rng.choice(list("abc"), 9)), urls.Segmenter(counts)

        def score(parts, model=model):
            return sum(model.known.get(p, model.unknown - 2.5 * len(p)) for p in parts)

        cuts = [[k for k in range(1, 9) if bits >> (k - 1) & 1] for bits in range(256)]
        best = max(score([text[i:j] for i, j in zip([0, *c], [*c, 9], strict=True)]) for c in cuts)
        assert "".join(model.split(text)) == text and score(model.split(text)) == pytest.approx(best)


def test_quotes(spark):
    rows = [
        (1, 0, "user", "Hello there\nsecond line"),
        (1, 1, "assistant", "> hello   THERE\nan answer"),
        (1, 2, "user", "unrelated"),
        (1, 3, "user", "> > hello there\n> an answer\nmore"),
        (1, 4, "user", "> nobody said this\nx"),
        (1, 300, "user", ">more\nlate"),
        (2, 0, "user", "> an answer"),
        (None, None, None, None),
    ]
    chat = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {(r.conv_id, r.turn): (r.reply_to, r.thread, r.depth, r.max_level) for r in quotes.conversations(chat).collect()}
    assert found[1, 1] == (0, 0, 1, 1) and found[1, 3] == (1, 0, 2, 2) and found[1, 300] == (3, 0, 3, 1)
    assert found[1, 4] == (None, 4, 0, 1) and found[2, 0] == (None, 0, 0, 1) and found[None, None] == (None, None, 0, 0)
    assert quotes.conversations(chat.where("false")).count() == 0


def test_quoted_passages_and_deeper_levels(spark):
    rows = [
        (1, 0, "first idea\nthanks\n\nbye"),
        (1, 1, "a plain answer\nof two lines"),
        (1, 2, "thanks"),
        (1, 3, ">> first idea\nonly the deeper level"),
        (1, 4, "> first idea\n> thanks\nthe whole passage"),
        (1, 5, ">> first idea\n>> thanks\n> a plain answer\n> OF two lines\nboth"),
        (1, 6, "> nobody's line\n> > > thanks\nx"),
        (1, 7, "> bye\n> first idea\nnot in this order"),
        (1, 8, "> thanks\n\n> thanks\n> bye\ntwo passages"),
        (2, 0, ">> first idea\nanother conversation"),
    ]
    chat = spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")
    found = {(r.conv_id, r.turn): (r.reply_to, r.thread, r.depth) for r in quotes.conversations(chat).collect()}
    assert found[1, 3] == (0, 0, 1) and found[1, 4] == (0, 0, 1)
    assert found[1, 5] == (1, 0, 2) and found[1, 1] == (0, 0, 1)  # that 1 answers 0 is known from 5
    assert found[1, 6] == (2, 2, 1) and found[1, 7] == (0, 0, 1) and found[1, 8] == (0, 0, 1)
    assert found[1, 0] == (None, 0, 0) and found[1, 2] == (None, 2, 0) and found[2, 0] == (None, 0, 0)
    twice = {(r.conv_id, r.turn, r.reply_to) for r in quotes.conversations(chat.unionAll(chat)).collect()}
    assert twice == {(*k, v[0]) for k, v in found.items()}


def test_pipeline(spark, small, benchmark_items):
    """Each stage by plain code over the rows the stage before it kept."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    found = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, small).collect()}
    passed = {r.doc_id for r in rules.report(docs).where("kept").collect()}
    rows = {r.doc_id: (r.source, r.text) for r in docs.collect() if r.doc_id in passed}
    pages = Counter(s for s, _ in rows.values())
    seen = Counter((s, line) for s, t in rows.values() for line in {x.strip(linefreq.BLANK) for x in t.split("\n")} if line)
    often = {k for k, n in seen.items() if n >= linefreq.MIN_PAGES and n > linefreq.RATIO * pages[k[0]]}
    texts = {k: "\n".join(x for x in t.split("\n") if (s, x.strip(linefreq.BLANK)) not in often) for k, (s, t) in rows.items()}
    classes = brute_classes(texts)
    known = windows(benchmark_items)
    expected = {k for k, c in classes.items() if k == c and not brute_hits(texts[k], known)[1]}
    assert found.keys() == expected
