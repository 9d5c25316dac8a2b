"""The training-data operators against brute force on small fixtures with odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import decontamination, fingerprints, html_extraction, language, minhash, packing, queries, sharding, suffix_dedup, tool_calls, url_filter
from graphloom.llm.kernels import LOWER

TABLE = "doc_id long, text string, lang string, source string, n_chars long, block int, part int, id long"


def documents(spark, rows):
    """Rows (doc_id, text[, lang]) with columns whose names clash with inner ones."""
    return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else None, "s", len(r[1] or ""), 1, 2, 3) for r in rows], TABLE)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    words = [f"w{i}" if i % 3 else f"é{i}" for i in range(900)]
    base = [[rng.choice(words) for _ in range(130)] for _ in range(4)]
    out = []
    for i in range(240):
        w = list(rng.choice(base)) if i % 2 else [rng.choice(words) for _ in range(rng.randint(1, 160))]
        for _ in range(rng.choice([0, 0, 1, 2, 5, 9])):
            w[rng.randrange(len(w))] = rng.choice(words)
        out.append((3 * i, " ".join(w)))
    return [*out, (9001, None), (9002, ""), (9003, " \n"), (9004, "Ab c"), (9005, "aB  c"), (9006, "x" * 5000), (9007, "ab" * 900)]


def test_repeats_match_brute_force(spark, texts):
    seen, want = {}, {}
    for doc, text in sorted(texts, key=lambda r: r[0]):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 99):
            if seen.setdefault(raw[p : p + 100], (doc, p)) < (doc, p):
                gone[p : p + 100] = b"\1" * 100
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        want[doc] = (len(raw), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(raw, gone) if not g)).hexdigest())
    for limit in (suffix_dedup.HOT_CONTEXTS, 4):
        got = suffix_dedup.repeated_spans(documents(spark, texts), hot=limit).collect()
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want
    odd = [(None, "q" * 150), (None, "q" * 150), (4, "p" * 300), (4, "p" * 300), (5, "p" * 120)]
    got = Counter((r.doc_id, r.n_removed) for r in suffix_dedup.repeated_spans(documents(spark, odd)).collect())
    assert got == Counter([(None, 149), (None, 149), (4, 299), (4, 299), (5, 120)])
    assert suffix_dedup.repeated_spans(documents(spark, [])).count() == 0
    kept = suffix_dedup.drop_repeats(documents(spark, texts))
    assert kept.columns == documents(spark, texts).columns and kept.count() == len(texts)
    assert kept.where("doc_id = 9001").first()["text"] is None


def test_long_texts_in_pieces_have_the_same_anchors():
    rng = random.Random(2)
    raw = np.frombuffer(bytes(rng.choice(b"abc") for _ in range(7000)), np.uint8)
    bounds = np.array([0, 150, 5000, 5050, 7000])
    found, old = [], suffix_dedup.SEGMENT
    for suffix_dedup.SEGMENT in (old, 200):  # the second one cuts texts of over 800 bytes
        key, _, row, lo, hi = suffix_dedup._anchors(raw, bounds, 100)
        found.append({(r, w, k) for k, r, a, b in zip(key.tolist(), row.tolist(), lo.tolist(), hi.tolist()) for w in range(a, b + 1)})
    suffix_dedup.SEGMENT = old
    assert found[0] == found[1] and {(r, w) for r, w, _ in found[0]} == {(r, w) for r in (0, 1, 3) for w in range(bounds[r + 1] - bounds[r] - 99)}


def test_refinement_classes_are_exact():
    rng = random.Random(1)
    data = np.frombuffer("".join(rng.choice(["abc" * 50, "x" * 130, "q", "abca"]) for _ in range(60)).encode(), np.uint8)
    at = np.arange(len(data) - 100)
    classes = suffix_dedup.refine_buckets(data, at)
    raw = data.tobytes()
    assert len(set(classes.tolist())) == len({raw[p : p + 100] for p in at}) == len({(c, raw[p : p + 100]) for c, p in zip(classes.tolist(), at.tolist())})


@pytest.mark.parametrize("words,percent,rows", [(3, 85, 5), (5, 80, 4)])
def test_near_groups_match_brute_force(spark, texts, words, percent, rows):
    sets = {}
    for doc, text in texts:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(bytes(LOWER)))
        sets[doc] = {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} - {()}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) > 0:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = minhash.near_groups(documents(spark, texts), minhash.NearRule(words=words, percent=percent, rows=rows, block=16)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {d: (len(sets[d]), find(d), find(d) == d) for d in sets}


def test_packing_is_exact_and_tight(spark, texts):
    from tokenizers import Tokenizer

    rows = [*texts, (9100, "Word's, <|endoftext|> İx ﬁ!! don't.. " * 900)]
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    ids = {d: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for d, t in rows}
    got = packing.pack_documents(documents(spark, rows), queries.tokenizer_path()).collect()
    places, sizes = defaultdict(list), Counter()
    for r in got:
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert r.start == 2048 * r.piece and zlib.crc32(np.array(own, "<u4").tobytes()) == r.ids_crc32
        places[r.sequence_id].append((r.offset, r.length))
        sizes[r.doc_id] += r.length
    assert sizes == {d: len(i) for d, i in ids.items()}
    for spot in places.values():
        spot.sort()
        assert all(o == sum(n for _, n in spot[:k]) for k, (o, _) in enumerate(spot)) and sum(n for _, n in spot) <= 2048
    assert len(places) <= -(-sum(sizes.values()) // 2048) + 1
    assert packing.pack_documents(documents(spark, []), queries.tokenizer_path()).count() == 0


def test_shards_keep_groups_and_are_even(spark, texts):
    rows = [*texts, *[(20000 + i, "same text") for i in range(400)], (20000, "same text")]
    got = sharding.shard_documents(documents(spark, rows)).collect()
    assert len(got) == len(rows) and {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    slots, groups = defaultdict(list), defaultdict(set)
    own = defaultdict(list)
    for d, t in rows:
        own[d].append(t or "")
    for r in got:
        assert (r.size, r.text_crc32) in {(len(t.encode()) + 8, zlib.crc32(t.encode())) for t in own[r.doc_id]}
        slots[r.shard].append(r.slot)
        groups[r.text_crc32].add(r.shard)
    assert set(slots) <= set(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(g) == 1 for g in groups.values())
    loads, sizes = Counter(), Counter()
    for r in got:
        loads[r.shard] += r.size
        sizes[r.text_crc32] += r.size
    assert max(loads.values()) == max(sizes.values())  # a group larger than the mean: no shard needs more
    assert sharding.shard_documents(documents(spark, [])).count() == 0
    even = documents(spark, [(i, "word " * (i % 97 + 1) + str(i)) for i in range(5000)])
    loads = [r.n for r in sharding.shard_documents(even).groupBy("shard").agg(F.sum("size").alias("n")).collect()]
    assert len(loads) == 24 and max(loads) <= 1.001 * sum(loads) / 24


def plain_best_fit(sizes, capacity):
    """Rooms left when items in falling order of size enter the tightest bin, one by one."""
    rooms = []
    for size in sorted(sizes, reverse=True):
        fits = [k for k, r in enumerate(rooms) if r >= size]
        if fits:
            rooms[min(fits, key=lambda k: rooms[k])] -= size
        else:
            rooms.append(capacity - size)
    return sorted(rooms)


def test_best_fit_over_a_histogram_equals_plain_best_fit():
    rng = random.Random(9)
    for _ in range(60):
        counts = Counter(rng.randint(1, rng.choice([8, 40, 300])) for _ in range(rng.randint(1, 200)))
        capacity = max(counts) + rng.randrange(200)
        runs = sharding.best_fit_decreasing(sorted(counts.items(), reverse=True), capacity, 10**6)
        rooms, last = Counter(), {}
        for k, (size, rank, box) in enumerate(runs):
            stop = runs[k + 1][1] if k + 1 < len(runs) and runs[k + 1][0] == size else counts[size]
            assert rank == last.get(size, 0) < stop
            last[size] = stop
            rooms[box] += size * (stop - rank)
        assert last == dict(counts) and sorted(capacity - n for n in rooms.values()) == plain_best_fit(counts.elements(), capacity)


def test_tree_gives_the_tightest_bin():
    rng, tree, rooms = random.Random(2), sharding.RoomTree(), []
    for k in range(3000):
        if rooms and rng.random() < 0.5:
            size = rng.randrange(60)
            want = min((r for r in rooms if r[0] >= size), default=None)
            assert tree.tightest(size) == want
            if want:
                rooms.remove(want)
        else:
            rooms.append((rng.randrange(60), k))
            tree.add(*rooms[-1])


def test_winnowing(spark, texts):
    order = sorted(((d, t or "") for d, t in texts), reverse=True)
    got = {r.doc_id: r for r in fingerprints.compared_with_edits(documents(spark, texts)).collect()}
    for (d, t), (_, later) in zip(order, order[1:] + order[:1]):
        k = len(t) // 3
        r = got[d]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256((t[: len(t) - k] + later[:k]).encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and (t != later or r.near_next == 1)
    def plain(text, gram=fingerprints.GRAM, window=fingerprints.WINDOW):
        """Selected (hash, place) pairs, window by window; the rightmost of equal least hashes."""
        raw = np.frombuffer(text.encode(), np.uint8)
        h = (fingerprints.rolling_hashes(raw, gram) >> np.uint64(24)).tolist()
        if not h:
            return None
        picks = {max(i for i in range(s, s + min(window, len(h))) if h[i] == min(h[s : s + window])) for s in range(max(1, len(h) - window + 1))}
        return [(h[i] >> 8, i) for i in sorted(picks)]

    def decoded(f):
        return [(int(f[i : i + 8], 16), int(f[i + 8 : i + 16], 16)) for i in range(0, len(f), 16)]

    for (d, t), (_, later) in zip(order, order[1:] + order[:1]):
        k, sides = len(t) // 3, []
        for text, own in ((t, got[d].fingerprint), (t[: len(t) - k] + later[:k], got[d].edited_fingerprint)):
            want = plain(text)
            assert decoded(own) == want if want is not None else len(own) == 16 * bool(text)
            sides.append({h for h, _ in decoded(own)})
        both = sides[0] | sides[1]
        assert got[d].near_edited == (len(sides[0] & sides[1]) / len(both) if both else 1.0)
    assert got[9001].fingerprint == got[9002].fingerprint == ""
    odd = [(None, "z" * 90), (7, "one two " * 20), (7, "one two " * 20), (None, None), (8, "x")]
    rows = fingerprints.compared_with_edits(documents(spark, odd)).collect()
    assert Counter((r.doc_id, r.n_chars) for r in rows) == Counter((d, len(t or "")) for d, t in odd)
    assert fingerprints.compared_with_edits(documents(spark, [])).count() == 0
    long, old = bytes(random.Random(6).choice(b"ab") for _ in range(9000)), fingerprints.LONG
    whole = fingerprints.winnow([long])[0]
    fingerprints.LONG = 1000
    parts = fingerprints.winnow([long])[0]
    fingerprints.LONG = old
    assert all((a == b).all() for a, b in zip(whole, parts))
    raw = bytes(random.Random(3).choice(b"abcd") for _ in range(700))
    pos, _ = fingerprints.winnow([raw], 5, 4)[0]
    h = fingerprints.rolling_hashes(np.frombuffer(raw, np.uint8), 5) >> np.uint64(24)
    want = sorted({max(i for i in range(s, s + 4) if h[i] == h[s : s + 4].min()) for s in range(len(h) - 3)})
    assert pos.tolist() == want


def test_leaks_and_reordered_passages(spark):
    rng = random.Random(8)
    words = [f"t{i}" for i in range(4000)]
    items = [(i, " ".join(rng.sample(words, 30))) for i in range(6)] + [(50, None), (51, ""), (52, "Only three words")]
    halves = items[1][1].split()
    docs = [
        (1, "Lead in. " + items[0][1].upper() + "!"), (2, " ".join([*halves[15:], "between", "them", *halves[:15]])), (3, " ".join(rng.sample(words, 200))), (4, None), (5, ""),
        (6, " ".join(items[2][1].split()[:12])), (7, "here are only, THREE words."), (8, items[3][1] + " " + items[3][1]),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.leaks(documents(spark, docs), bench).collect()}
    assert got == {(1, 0), (2, 1), (7, 52), (8, 3)}
    assert {r.doc_id for r in decontamination.drop_leaking(documents(spark, docs), bench).collect()} == {3, 4, 5, 6}
    assert decontamination.leaks(documents(spark, docs), bench.where("false")).count() == 0


def test_language(spark):
    rng = random.Random(5)
    stems = {"en": "the ing tion and was his".split(), "de": "sch ein und der keit lich".split(), "fr": "eau ment les que aux oir".split()}
    rows = [(i, " ".join("".join(rng.choice(stems[lang]) for _ in range(rng.randint(1, 3))) for _ in range(60)), lang) for i in range(150) for lang in [rng.choice(list(stems))]]
    odd = [(900, None, "en"), (901, "12 34 !!", "de"), (902, "", None)]
    docs = documents(spark, [*rows, *odd])
    judged = {r.doc_id: r for r in language.identify(docs, language.learn(docs, ~language.held_out()), ["doc_id"]).collect()}
    assert all(judged[i].lang_pred == lang and 0 <= judged[i].score <= 1 for i, _, lang in rows)
    assert {judged[i].lang_pred for i, *_ in odd} == {"und"}
    clash = docs.select("*", *[F.lit(k).alias(c) for k, c in enumerate(["score", "lang_pred", "fits", "c0", "c1"])])
    kept = language.drop_unidentified(clash.unionByName(clash.where("doc_id < 5")))
    assert kept.columns == clash.columns and kept.count() == len(rows) + sum(r[0] < 5 for r in rows)
    assert kept.where("score != 0 or c1 != 4").isEmpty() and language.drop_unidentified(docs.where("false")).count() == 0
    assert {r.lang_pred for r in language.identify(docs, language.learn(docs.where("false"), F.lit(True)), ["doc_id"]).collect()} == {"und"}


@pytest.mark.parametrize("unlearned", ["en", "de"])
def test_unlearned_language_is_dropped(spark, unlearned):
    whole = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("was", F.col("lang"))
    starts = whole.select((F.col("doc_id") + 10_000_000).alias("doc_id"), F.substring("text", 1, 50).alias("text"), F.lit(None).cast("string").alias("lang"), "was")
    docs = whole.select("doc_id", "text", F.when(F.col("was") != unlearned, F.col("lang")).alias("lang"), "was").unionByName(starts)
    size = F.octet_length("text") >= 64
    letters = docs.where(F.col("text").rlike("[A-Za-z]{4}"))
    for long, most, least in ((True, 0.02, 0.98), (False, 0.1, 0.95)):
        of = {r.unlearned: r.n for r in letters.where(size == long).groupBy((F.col("was") == unlearned).alias("unlearned")).agg(F.count("*").alias("n")).collect()}
        kept = {r.unlearned: r.n for r in language.drop_unidentified(docs).where(size == long).groupBy((F.col("was") == unlearned).alias("unlearned")).agg(F.count("*").alias("n")).collect()}
        print(unlearned, long, of, kept)
        assert kept.get(True, 0) <= most * of[True] and kept[False] >= least * of[False]


def test_more_languages_than_a_word(spark):
    rng = random.Random(6)
    own = {f"l{k:02}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(12)] for k in range(70)}
    rows = [(100 * k + i, " ".join(rng.choice(own[lang]) for _ in range(40)), lang) for k, lang in enumerate(own) for i in range(8)]
    docs = documents(spark, rows)
    judged = language.identify(docs, language.learn(docs, ~language.held_out()), ["doc_id", "lang"]).collect()
    assert len(judged) == len(rows) and all(r.lang_pred == r.lang for r in judged)
    assert language.drop_unidentified(docs).count() == len(rows)


def test_html():
    page = """<html><head><title>t</title><style>p{}</style></head><body><nav><a href="/x">Home</a></nav><div class="cookie-notice">We use cookies.</div>
    <article><h1>A &amp; B</h1><p>First   line<br>goes on</p><script>var a = "</p>";</script><p>Short.</p><form>Name<input></form><div class="comments"><p>Nice post</p></div></article>
    <aside>More</aside><footer>&copy; x</footer></body></html>"""
    assert html_extraction.main_text(page) == ["A & B", "First line goes on", "Short."]
    loose = "<div><a href=/>Menu</a></div><div>" + "<p>" + "word " * 60 + "</p><p>tail</p></div><div><a href=/a>one</a> <a href=/b>two</a></div><p cut='"
    assert html_extraction.main_text(loose) == [("word " * 60).strip(), "tail"]
    assert html_extraction.main_text(None) == html_extraction.main_text("") == []


def test_html_without_marked_article():
    def page(*blocks):
        menu = "<div><a href=/a>Home</a></div><div><a href=/b>News of today</a></div><div><a href=/c>Contact</a></div>"
        return f"<body>{menu}{''.join(blocks)}{menu}</body>"

    def p(n):
        return f"<p>{'x' * n}</p>"

    ad = '<div class="ad"><p>Buy this now</p><p>or that</p></div>'
    assert [len(t) for t in html_extraction.main_text(page(p(900), p(800), p(700), ad, p(300), p(200)))] == [900, 800, 700, 300, 200]
    assert [len(t) for t in html_extraction.main_text(page(p(900), ad, p(70)))] == [900, 70]
    assert [len(t) for t in html_extraction.main_text(page(f"<h1>{'h' * 20}</h1>", p(15), p(16), p(400)))] == [20, 15, 16, 400]
    links = "".join(f"<p><a href=/{i}>More of this</a></p>" for i in range(4))
    assert [len(t) for t in html_extraction.main_text(page(p(4000), links, p(30), p(100)))] == [4000, 30, 100]


def test_rare_words_of_many_documents_are_learned(spark):
    """Words that two documents in 36,000 hold are learned, whichever these are, and gates rest on all the others."""
    word = F.when(F.col("id") < 50, F.repeat(F.chr(F.lit(98) + F.col("id") % 25), F.lit(4))).otherwise("aaaa")
    docs = spark.range(36_000).select(F.col("id").alias("doc_id"), word.alias("text"), F.lit("en").alias("lang"))
    model = language.learn(docs, F.lit(True))
    rare = language.identify(docs.where("doc_id < 25"), model, ["doc_id"]).collect()
    assert len(rare) == 25 and all(r.score > 0.99 for r in rare)


def test_records_between_blocks_and_parts_stay_few(spark, monkeypatch):
    """A passage in every text: records of a pass follow from blocks and parts, not from the texts."""
    common, seen = "".join(random.Random(1).choices("abcdefgh ", k=160)), []
    docs = spark.createDataFrame([(k, f"{k} {common}") for k in range(300)], "doc_id long, text string")
    over = type(docs).groupBy
    monkeypatch.setattr(type(docs), "groupBy", lambda self, *by: (by == ("part",) and seen.append(self)) or over(self, *by))
    found = suffix_dedup.repeated_spans(docs)
    assert found.where("n_removed >= 100").count() == 299
    keys = seen[0].count()
    assert seen[0].columns == ["part", "block", "kind", "blob"] and keys <= 2 * 2 * 2


def plain_line_blocks(lines):
    """Lines (text, count) between dives around which some window surges, written out over windows."""
    n, windows = len(lines), [sum(c for _, c in lines[i : i + 3]) for i in range(len(lines))]
    surge, part, kept = min(80, max(windows, default=0)), [None] * n, []
    for i in range(n):
        part[i] = i if windows[i] and (i == 0 or not windows[i - 1]) else part[i - 1] if windows[i] else None
    for p in sorted({p for p in part if p is not None}):
        own = [i for i in range(n) if part[i] == p]
        if any(windows[i] >= surge for i in own):
            counted = [i for i in own if lines[i][1]]
            kept += [lines[i][0] for i in range(counted[0], counted[-1] + 1) if lines[i][0]]
    return kept


def test_html_table_against_plain_line_blocks(spark):
    rng = random.Random(31)
    block = lambda: rng.choice([f"<p>{'w' * rng.choice([3, 20, 90, 400])}</p>", "<div><a href=/x>link text here</a></div>", "<ul><li><a href=/>a</a></li><li>b</li></ul>", "<hr>", "<div class='ad'><p>buy</p></div>", "<p>t &amp; <b>u</b>"])
    pages = []
    for k in range(300):
        body = "".join(block() for _ in range(rng.randint(0, 14)))
        pages.append((k, f"http://x/{k}", body if k % 3 else f"{body}<article>{''.join(block() for _ in range(rng.randint(0, 9)))}</article>{body}"))
    pages += [(900, None, None), (901, "u", ""), (902, "u", "<p>once"), (902, "u", "<p>once"), (None, "u", "<article>x</article>"), (903, "u", "<article><p>" + "long words " * 300_000 + "</p></article>")]
    table = spark.createDataFrame([(*r, "clash", 1) for r in pages], "page_id long, url string, html string, text string, n_chars long")
    got = html_extraction.extract(table).collect()
    assert sorted((r.page_id is None, r.page_id, r.url or "", r.text) for r in got if r.page_id is not None) == sorted((False, k, u or "", "\n\n".join(plain_line_blocks(html_extraction.weighed(h)))) for k, u, h in pages if k is not None)
    assert [r.text for r in got if r.page_id is None] == ["x"] and all(r.n_chars == len(r.text) for r in got)
    assert {len(r.text) for r in got if r.page_id == 903} == {len("long words ") * 300_000 - 1}
    assert html_extraction.extract(table.where("false")).count() == 0


def test_html_names_and_depth():
    import time

    page = lambda x: f"<body><div class=menu>Home</div><article><p>{'a' * 300}</p>{x}<p>{'b' * 200}</p></article></body>"
    inner = lambda x: html_extraction.main_text(page(x))[1:-1]
    for kept in ('<div class="related-work">Work</div>', '<section id="notice-of-results">Work</section>', '<p class="tags">Work</p>', "<p><math><mi>Work</mi></math></p>", "<p><svg><text>Work</text></svg></p>", "<p><object>Work</object></p>", "<p><a href=/>Work</a></p>", "<p>Wo<span class=ad>Buy</span>rk</p>"):
        assert inner(kept) == ["Work"], kept
    for gone in ('<div class="ad-banner">Buy</div>', '<div class="relatedPosts">More</div>', '<p class="notice">We</p>', '<ul><li class="comment">Me<li class="comment">You</ul>', '<section id="comments"><p>Hi</p></section>', "<button>Share</button>", "<p class=advert>Buy"):
        assert inner(gone) == [], gone
    deep, began = "<div>" * 20_000 + "text" + "</div>" * 20_000, time.process_time()
    assert html_extraction.main_text(deep) == ["text"] and time.process_time() - began < 1.5
    # Without a marked article a link paragraph between paragraphs stays, and text far from it that surges does too.
    free = f"<body><p>{'a' * 300}</p><p><a href=/>Read all of it</a></p><p>{'b' * 90}</p></body>"
    assert [len(x) for x in html_extraction.main_text(free)] == [300, 14, 90]


def test_urls(spark):
    urls = [None, "no scheme/porn", "http://A.Example.com/en/7?x", "https://x.com/en/1#a", "http://free-bets.example.net/de/80", "http://x.org/sexton/", "http://a.b/track/ads", "http://ads.ads/"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages).collect()}
    assert got[0] == ("", "", None, "allow") and got[1] == ("", "", None, "block")
    assert got[2] == ("a.example.com", "/en/7", "example.com/en/7", "allow") and got[3][2:] == ("com/en/", "block")
    odd = pages.unionByName(pages).unionByName(spark.createDataFrame([(None, "http://x.com/en/" + "y" * 2_000_000, "h")], pages.schema))
    rows = url_filter.judge_urls(odd).collect()
    assert Counter(r.page_id for r in rows) == Counter([*range(len(urls))] * 2 + [None])
    assert all((r.host, r.path, r.rule, r.verdict) == got[r.page_id] for r in rows if r.page_id is not None)
    assert [r.verdict for r in rows if r.page_id is None] == ["block"] and url_filter.judge_urls(pages.where("false")).count() == 0
    assert got[4][2:] == ("example.net/de/8", "block") and got[5][3] == "allow" and got[6][3] == "block" and got[7][3] == "allow"


def test_tool_calls(spark):
    call = '{"content":"x","tool_calls":[{"id":"a","name":"search","arguments":{"query":"q","limit":"3"}},{"id":"b","name":"fetch","arguments":"{\\"url\\":\\"u\\"}","depends_on":["a"]}]}'
    rows = [
        (1, 0, "user", "hi"), (1, 1, "tool", '{"tool_call_id":"b","content":1}'), (1, 2, "assistant", call), (1, 3, "tool", '{"tool_call_id":"a","content":"z"}'), (1, 4, "tool", '{"tool_call_id":"zz"}'),
        (2, 0, "assistant", '{"tool_calls":[{"id":"a","name":"nope","arguments":{}},{"id":"c","name":"calculate","arguments":{},"depends_on":["d"]},{"id":"d","name":"calculate","arguments":[1],"depends_on":["c"]}]}'),
        (None, None, None, None), (2, 1, "assistant", "{broken"),
    ]
    got = tool_calls.link_tool_calls(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    calls = {(r.conv_id, r.call_id): r for r in got if r.kind == "call"}
    assert calls[1, "a"].errors == "not a integer: limit" and calls[1, "a"].linked and not calls[1, "a"].valid and calls[1, "a"].topo_level == 0
    assert calls[1, "b"].errors == "" and calls[1, "b"].topo_level == 2
    assert calls[2, "a"].errors == "no result; unknown tool" and "cycle" in calls[2, "c"].errors and "missing expression" in calls[2, "c"].errors
    results = {r.call_id: r for r in got if r.kind == "result"}
    assert results["b"].topo_level == 3 and results["zz"].errors == "no call"
    assert calls[1, "a"].canonical == '{"arguments":{"limit":"3","query":"q"},"id":"a","name":"search"}'
    assert sum(r.kind == "message" for r in got) == 5
    assert tool_calls.link_tool_calls(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def plain_levels(needs):
    """Longest chain below each call, two for each step; None on and above cycles."""
    level, left = {c: 0 for c, on in needs.items() if not on}, True
    while left:
        left = {c: 2 + max(level[o] for o in on) for c, on in needs.items() if c not in level and all(o in level for o in on)}
        level |= left
    return {c: level.get(c) for c in needs}


def test_tool_calls_against_plain_python(spark):
    import json

    rng, rows, want = random.Random(21), [], {}
    for conv in range(12):
        names = [f"c{k}" for k in range(rng.choice([1, 5, 30]))]
        if conv == 11:
            names = [f"c{k}" for k in range(150)]
        for k, name in enumerate(names):
            needs = [names[k - 1]] if conv == 11 and k else [rng.choice(names[: k + (conv % 4 == 0)] or names) for _ in range(rng.choice([0, 1, 1, 3]))] if conv < 11 else []
            want[conv, name] = sorted({n for n in needs} if conv % 4 == 0 else {n for n in needs if n != name})
            needs = want[conv, name] + ["elsewhere"] * (conv == 3)
            arguments = rng.choice([{"query": "q"}, '{"query": "q", "limit": 2}', {"limit": 1.5}, "no json", [1], {"query": 1, "z": None}, None])
            rows.append((conv, 2 * k, "assistant", json.dumps({"tool_calls": [{"id": name, "name": "search", "arguments": arguments, "depends_on": needs}], "content": "c"})))
            if k % 3:
                rows.append((conv, 2 * k + 1, "tool", json.dumps({"tool_call_id": name, "content": k})))
    copies = rng.sample(rows, 25)
    rows += copies
    rows += [(None, 1, "assistant", '{"tool_calls":[{"id":"c0","name":"search","arguments":{"query":"q"}}]}'), (5, None, "assistant", '{"tool_calls":[{"id":"late","name":"nope","arguments":{}}]}'), (5, 900, "assistant", '{"tool_calls":[{"id":"c0","name":"search","arguments":{"query":"again"}}]}')]
    table = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "conv_id long, turn long, role string, text string, level int, errors string, needs int")
    got = tool_calls.link_tool_calls(table).collect()
    counts = Counter((r.conv_id, r.turn, r.place) for r in got if r.kind == "call")
    assert counts == Counter((c, t, 0) for c, t, role, _ in rows if role == "assistant")
    levels = plain_levels({k: [(k[0], n) for n in on] for k, on in want.items()})
    for r in (r for r in got if r.kind == "call"):
        if r.conv_id is None:
            assert r.errors == "no conversation; no result" and not r.linked and r.topo_level is None
        elif r.call_id == "late":
            assert r.errors == "no result; unknown tool" and not r.valid
        elif r.turn == 900:
            assert "duplicate id" in r.errors and not r.linked
        else:
            key, k = (r.conv_id, r.call_id), r.turn // 2
            body = json.loads(r.canonical)
            assert r.topo_level == levels[key] and ("cycle" in r.errors) == (levels[key] is None)
            assert r.linked == bool(k % 3) and ("no result" in r.errors) == (not k % 3)
            a = body["arguments"]
            bad = {"missing query"} if isinstance(a, dict) and "query" not in a else set()
            if isinstance(a, dict):
                bad |= {"not a integer: limit"} if a.get("limit") == 1.5 else set()
                bad |= {"not a string: query", "unknown z"} if "z" in a else set()
            else:
                bad = {"arguments are no object", "missing query"}
                assert a in (None, "no json", [1])
            assert set(r.errors.split("; ")) - {"cycle", "no result", ""} == bad and r.valid == (not bad)
    assert max(x for x in levels.values() if x is not None) == 298 and None in levels.values()
    results = [r for r in got if r.kind == "result"]
    assert len(results) == sum(role == "tool" for _, _, role, _ in rows)
    assert all(r.linked and (levels[r.conv_id, r.call_id] is None) == (r.topo_level is None) and r.topo_level in (None, 1 + (levels[r.conv_id, r.call_id] or 0)) for r in results)


def test_pipeline_keeps_columns(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns
    assert 0 < docs.count() < before


def greedy_tiling(text, item, width):
    """Words of ``item`` in tiles: the longest free common run is marked again and again."""
    in_text, in_item = set(), set()
    while True:
        best = (0, 0, 0)
        for a in range(len(text)):
            for b in range(len(item)):
                n = 0
                while a + n < len(text) and b + n < len(item) and text[a + n] == item[b + n] and a + n not in in_text and b + n not in in_item:
                    n += 1
                if n > best[0]:
                    best = (n, a, b)
        n, a, b = best
        if n < width:
            return len(in_item)
        in_text.update(range(a, a + n))
        in_item.update(range(b, b + n))


def test_leaks_match_brute_force(spark):
    rng = random.Random(12)
    words = [f"v{i}" for i in range(12)]
    items = [(i, [rng.choice(words) for _ in range(rng.choice([3, 5, 12, 24]))]) for i in range(14)]
    items += [(14, ["v0"] * 9), (15, items[3][1])]
    docs = []
    for i in range(60):
        text = [rng.choice(words) for _ in range(rng.randint(0, 20))]
        for _ in range(rng.randint(0, 3)):
            item = rng.choice(items)[1]
            a = rng.randrange(len(item))
            text = rng.choice([text + item[a:], item[: a + 1] + text, text + item, text + item[a:] + item[:a]])
        docs.append((i, text))
    docs.append((90, ["v0"] * 30))
    want = {(d, i) for d, text in docs for i, item in items if greedy_tiling(text, item, min(5, len(item))) >= 0.6 * len(item)}
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    got = [(r.doc_id, r.item_id) for r in decontamination.leaks(documents(spark, [(d, ", ".join(w).upper()) for d, w in docs]), bench).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20


def test_pipeline_of_odd_and_empty_tables(spark, texts):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    odd = documents(spark, [*texts[:40], *texts[-7:], (None, None), (None, "words of nobody at all"), (3, texts[1][1])])
    for docs in (odd, odd.where("false")):
        docs = docs.withColumn("lang", F.when(F.col("text").isNotNull(), "xx"))
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf)
            if name != "packing":
                assert docs.columns == odd.columns
        rows = docs.collect()
        assert all(r.offset >= 0 and 0 < r.length <= 2048 for r in rows)
    assert rows == []


def test_repeated_words_need_little_memory(spark):
    import tracemalloc

    rng = random.Random(17)
    one = np.zeros(20_000, np.uint64)
    tracemalloc.start()
    p, q, n = decontamination.diagonals(one, np.arange(len(one)), one[:396])
    found = decontamination.tiles(p, q, n + 4, 5)
    assert tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()
    assert len(p) == len(one) + 395 and found == [(0, 0, 400)]
    for _ in range(200):  # small alphabets: steps of any size give the runs of single comparisons
        text, item = (np.array([rng.randrange(3) for _ in range(rng.randrange(1, 40))], np.uint64) for _ in range(2))
        same = {(i, j) for i in range(len(text)) for j in range(len(item)) if text[i] == item[j]}
        runs = {(i, j, next(k for k in range(50) if (i + k, j + k) not in same)) for i, j in same if (i - 1, j - 1) not in same}
        got = decontamination.diagonals(text, np.arange(len(text)), item, rng.choice([1, 7, 1000]))
        assert set(zip(*(x.tolist() for x in got))) == runs
    docs = documents(spark, [(1, "na " * 2000), (2, "\u201cNa\u2014na\u201d, NA na \u00c9t\u00e9\u2026 na na na"), (3, None)])
    bench = spark.createDataFrame([*[(i, "na " * 400) for i in range(20)], (40, "na na na na \u00e9t\u00e9 na na na"), (41, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.leaks(docs, bench).collect()}
    assert got == {*((1, i) for i in range(20)), (2, 40)}
    assert decontamination.leaks(docs.where("false"), bench).count() == 0


def test_recall_on_shared_documents(spark):
    """Every link of the documents whose id is divisible by 50, against all rows by full sets."""
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r.doc_id: r.text for r in table.select("doc_id", "text").collect()}
    sets = {}
    for d, t in rows.items():
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(bytes(LOWER)))
        sets[d] = {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} - {()}
    got = {r.doc_id: r.component_id for r in minhash.near_groups(table, minhash.NearRule(words=3, percent=85, rows=5)).collect()}
    links = [(a, b) for a in rows if a % 50 == 0 for b in rows if a != b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    assert got.keys() == rows.keys() and all(got[a] == got[b] for a, b in links)


def test_languages_of_shared_documents(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    judged = queries.op8_language_id(spark, "/root/testdata/sf0.01").join(table.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null and lang_pred != 'und'")
    right = judged.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right >= 0.99


@pytest.mark.parametrize("n", [400, 1600])
def test_family_just_under_the_threshold(spark, n):
    """Pairs that all stay below it give no links; rows that leave a block grow with the documents."""
    rng = np.random.default_rng(1)
    rows = []
    for i in range(n):
        w = [f"b{k}" for k in range(300)]
        for p in rng.choice(300, 9, replace=False).tolist():
            w[p] = f"u{i}x{p}"
        rows.append((i, " ".join(w)))
    near = [(n + i, rows[i][1] + " end") for i in range(0, n, 10)]
    got = {r.doc_id: r.component_id for r in minhash.near_groups(documents(spark, rows + near), minhash.NearRule(words=3, percent=85, rows=5, block=256)).collect()}
    assert got == {**{i: i for i in range(n)}, **{n + i: i for i in range(0, n, 10)}}
