"""The ten operators on small fixtures, against brute force, libraries or exact round trips."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
from collections import Counter

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from wakelens.llm import byte_bpe, decontamination, language_id, main_text, privacy, quality_rules, repeated_passages, sharding, similar_texts, token_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, hits long, set string"


def words(n, seed):
    return " ".join(f"w{(seed * 7919 + i * i * 31 + i) % 9973}" for i in range(n))


@pytest.fixture(scope="module")
def texts():
    """Nulls, empty and long texts, ties, repeated rows and near copies."""
    base = words(200, 1)
    near = base.replace(base.split()[90], "changed", 1)
    passage = words(60, 5)
    return [
        (1, base, "en"), (2, base, "en"), (3, near, None), (4, None, "en"), (5, "", None), (6, " \t\n ", "en"),
        (7, "one two", "fr"), (8, "ONE two", "fr"), (9, words(30, 2) + " " + passage + " " + words(40, 3), "en"),
        (10, passage + " tail " + passage, "de"), (11, words(30000, 4), "en"), (7, "one two", "fr"), (None, "lone words here", None), (12, "a b c d e f g h i j k l", "en"),
    ]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, lang, 0, "x") for i, t, lang in texts], DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_language(spark, docs, empty):
    samples = [(i, t, lang, 0, "") for i, (t, lang) in enumerate([("the cat and the dog of the house", "en"), ("le chat et le chien de la maison", "fr"), ("der hund und die katze im haus", "de")] * 8)]
    train = spark.createDataFrame(samples, DOCS)
    model = language_id.fit(train)
    probe = spark.createDataFrame([(1, "the dog and the house", None, 0, ""), (2, "la maison et le chien", None, 0, ""), (3, None, None, 0, ""), (4, "123 !!", None, 0, "")], DOCS)
    got = {r.id: (r.lang_pred, r.score) for r in language_id.predict(probe, model).collect()}
    assert (got[1][0], got[2][0]) == ("en", "fr") and got[3] == got[4] == ("und", 0.0)
    assert language_id.predict(docs, model).count() == docs.count()
    nothing = language_id.fit(empty)
    assert {r.lang_pred for r in language_id.predict(probe, nothing).collect()} == {"und"}
    assert language_id.predict(empty, model).count() == 0


def test_language_sample_is_that_of_lowest_hashes(spark, empty):
    frame = spark.createDataFrame([(i, f"text {i}", "en" if i % 5 else "de", 0, "") for i in range(1000)], DOCS)
    rows = frame.select("lang", "text", F.xxhash64("doc_id").alias("h")).collect()
    for bound in (1, 7, 500):
        want = {r.text for lang in ("en", "de") for r in sorted((r for r in rows if r.lang == lang), key=lambda r: r.h)[:bound]}
        got = [r.text for r in language_id.labelled_sample(frame, "doc_id", "text", "lang", bound).collect()]
        assert len(got) == len(want) and set(got) == want
    assert language_id.labelled_sample(empty, "doc_id", "text", "lang", 7).count() == 0


def test_codewords_lie_apart():
    for n in (2, 3, 5, 12, 40):
        code = language_id.codewords(n)
        apart = min(int((code[i] != code[j]).sum()) for i in range(n) for j in range(i))
        assert apart >= (1 if n == 2 else 2)


def stats(text):
    text = text or ""
    found = WORD.findall(text)
    grams = Counter(tuple(found[i : i + 5]) for i in range(len(found) - 4))
    covered = {k for i in range(len(found) - 4) if grams[tuple(found[i : i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(found), sum(map(len, found)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_statistics(spark, docs, texts, empty):
    extra = [(50, "x\ny\nx\n\nx", None, 0, ""), (51, "a b c d e a b c d e f a b c d e", None, 0, ""), (52, "a a a a a a a", None, 0, ""), (53, "## é | b<", None, 0, "")]
    rows = docs.unionByName(spark.createDataFrame(extra, DOCS))
    want = {(i, stats(t)) for i, t, *_ in [*texts, *extra]}
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = {(r.id, tuple(r[c] for c in columns)) for r in quality_rules.statistics(rows).collect()}
    assert got == want
    assert quality_rules.statistics(empty).count() == 0


def test_quality_rules_are_learned(spark):
    rows = [(i % 3 == 0, i % 5 != 0, 4.0, 0.3 if i % 5 == 0 else 0.01, 0.0, 0.0, 0.0, 50.0 + i) for i in range(300)]
    frame = spark.createDataFrame(rows, ["pruning", "good", *quality_rules.features()])
    found = quality_rules.fit(frame)
    assert [str(c) for c in found.rules[0].conditions] and found.rules[0].conditions[0].feature == "symbol_share"
    verdict = frame.select("good", found.expression({n: F.col(n) for n in quality_rules.features()}).alias("kept"))
    assert verdict.where("good <> kept").count() == 0
    assert quality_rules.fit(frame.limit(0)).rules == []


def test_private_data(spark, docs, empty):
    text = "mail a.b@x.org, call +1 (017) 555-7713; card 4539 1488 0343 6467 at 10.0.0.256 or 10.0.0.1"
    assert [(k, text[a:b]) for k, a, b in privacy.base_spans(text)] == [("email", "a.b@x.org"), ("ip", "10.0.0.1"), ("card", "4539 1488 0343 6467"), ("phone", "+1 (017) 555-7713")]
    assert privacy.base_spans("9" * 50000) == privacy.base_spans(None) == []
    # A term that stands by one address only, in many surroundings, discloses it.
    rows = [(i, f"{words(6, i)} zorblax {words(2, i + 50)} me@site.org {words(30, i + 90)}", None, 0, "") for i in range(12)]
    rows += [(100 + i, words(60, 200 + i), None, 0, "") for i in range(60)]
    frame = spark.createDataFrame(rows, DOCS)
    terms = privacy.disclosing_terms(frame).cache()
    assert {r.name for r in terms.collect()} == {"zorblax"}
    found = {r.id: r for r in privacy.find(frame, terms).collect()}
    assert len(found) == 72 and all(len(found[i].added) == 1 and len(found[i].base) == 1 for i in range(12))
    clean = {r.doc_id: r for r in privacy.sanitise(frame).collect()}
    assert all("zorblax" not in clean[i].text and "<email>" in clean[i].text for i in range(12)) and clean[100].text == rows[12][1] and clean[0].set == ""
    assert privacy.sanitise(docs).count() == docs.count() and privacy.sanitise(empty).count() == 0


def test_disclosure_against_brute_force(spark):
    """Terms and disclosures equal those counted in plain Python over distinct surroundings."""
    rng = random.Random(11)
    people = [("ann@one.org", "annie"), ("bob@one.org", "bobby"), ("cy@two.net", "cyrus"), ("+1 (017) 555-7713", "dora")]
    texts = []
    for k in range(90):
        address, nick = rng.choice(people)
        firm = "onecorp" if "one.org" in address else rng.choice(["foo", "bar"])
        body = [rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta"]) + str(rng.randrange(9)) for _ in range(30)]
        body[10:10] = [nick, firm, address, rng.choice(["annie", "the", "the", "the"])] if k % 3 else [rng.choice(["cyrus", "the"])]
        texts.append(" ".join(body))
    frame = spark.createDataFrame([(k, t, None, 0, "") for k, t in enumerate(texts)], DOCS)
    near, places, names = {}, {}, {}
    for t in texts:
        words, spans = [(m[0], *m.span()) for m in re.finditer(r"\S+", t)], privacy.base_spans(t)
        low = [w.lower() for w, _, _ in words]
        place = [tuple(low[i] if 0 <= i < len(low) else None for i in range(k - 3, k + 4)) for k in range(len(low))]
        strip = [w.strip("".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum())) for w in low]
        for k, w in enumerate(strip):
            places.setdefault(w, set()).add(place[k])
        taken = {k for k, (_, a, b) in enumerate(words) for _, x, y in spans if a < y and x < b}
        for kind, x, y in spans:
            own = [k for k, (_, a, b) in enumerate(words) if a < y and x < b]
            for entity in [t[x:y]] + ([t[x:y].split("@")[1]] if kind == "email" else []):
                near.setdefault((entity, kind), {}).setdefault("", set()).add(place[own[0]])
                for k in [*range(max(0, own[0] - 8), own[0]), *range(own[-1] + 1, min(len(low), own[-1] + 9))]:
                    if k not in taken and len(strip[k]) > 1:
                        near[entity, kind].setdefault(strip[k], set()).add(place[k])
    want = {}
    for (entity, kind), terms in near.items():
        information = -math.log(min(0.5, len(terms[""]) / len(texts)))
        for term, seen in terms.items():
            n, m = len(seen), len(places.get(term, ()))
            if term and n >= 2:
                share = n / m
                low = (share + 1 / (2 * m) - math.sqrt(share * (1 - share) / m + 1 / (4 * m * m))) / (1 + 1 / m)
                if low >= 0.5 and 1 + math.log(low) / information >= 0.9:
                    want[term] = max(want.get(term, 0), 1 + math.log(low) / information)
    got = {r.name: r.disclosure for r in privacy.disclosing_terms(frame).collect()}
    assert got == pytest.approx(want) and {"bobby", "dora"} <= set(got) and "the" not in got


def test_extra_columns_with_the_names_used_inside(spark):
    names = ["_low", "base", "Added", "_own", "_id", "_key", "_gone", "_many", "Score", "lang_pred", "ambiguous", "id", "key"]
    rows = [(i, f"{words(6, i)} zorblax {words(2, i + 50)} me@site.org {words(30, i + 90)}") for i in range(12)]
    rows += [(20, rows[3][1]), (21, None), (22, "")] + [(100 + i, words(60, 200 + i)) for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit(n).alias(n) for n in names])
    clean = privacy.sanitise(frame)
    assert clean.columns == frame.columns and clean.count() == 75
    assert all("zorblax" not in (r.text or "") and r.base == "base" for r in clean.collect())
    kept = similar_texts.representatives(frame)
    assert kept.columns == frame.columns and sorted(r.doc_id for r in kept.where("doc_id < 100").collect()) == [*range(12), 21, 22]
    learn = spark.createDataFrame([(i, words(40, i), "en" if i % 2 else "de") for i in range(12)], "doc_id long, text string, lang string")
    labelled = language_id.label(frame, language_id.fit(learn))
    assert len({c.lower() for c in labelled.columns}) == len(labelled.columns) and labelled.count() == 75


def test_main_text(spark):
    page = "<html><head><title>t</title></head><body><nav><li>Menu</ul></nav><div class='cookie-notice'>ok?</div><article><h1>Head &amp; more</h1><p>First <b>bo</b>ld<br>line<p>Second&nbsp;{}</p><div class=comments>me too</div></article><footer>f</footer></body>"
    rows = [(i, f"http://h/{i}", page.format(i)) for i in range(8)] + [(20, None, None), (21, "x", ""), (22, "http://h/9", "<p>open &bogus; <script>var a='<p>no</p>'</script>text")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.id: r.text for r in main_text.extract(frame, main_text.induce(frame)).collect()}
    assert got[3] == "Second 3" and got[20] == got[21] == "" and got[22] == "open &bogus; text" and len(got) == 11
    single = {r.id: r.text for r in main_text.extract(frame, main_text.induce(frame.where("page_id > 6"))).collect()}
    assert single[3] == "Head & more First bold line Second 3"
    assert main_text.extract(frame.limit(0), main_text.induce(frame.limit(0))).count() == 0


def test_a_hot_host_is_dealt_out(spark):
    rows = [(i, "http://h/x", f"<body><p>same</p><div>{'<b>x</b>' * i}<p>own {i}</p></div></body>") for i in range(40)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    split = main_text.induce(frame, group_pages=4)
    assert "hashpartitioning(unit" in split._jdf.queryExecution().executedPlan().toString()
    got = {r.id: r.text for r in main_text.extract(frame, split).collect()}
    assert all(got[i].endswith(f"own {i}") and "same" not in got[i] for i in range(40))


@pytest.mark.parametrize("odd", ["", "<article><p>fragment</p></article>", "<hr>"])
def test_a_page_without_the_template_takes_no_votes_away(spark, odd):
    rows = [(0, "http://h/0", odd)] + [(i, f"http://h/{i}", f"<html><body><p>own {i}</p><div class=end><p>All rights reserved</p></div></body></html>") for i in range(1, 8)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.id: r.text for r in main_text.extract(frame, main_text.induce(frame)).collect()}
    assert all(got[i] == f"own {i}" for i in range(1, 8))


def test_the_reference_takes_in_what_it_lacks():
    pages = [main_text.skeleton(f"<div>{x}</div>") for x in ("<p>a</p><p>b</p>", "<p>a</p><ul><li>x</ul><p>b</p>", "<h2>t</h2><p>a</p><ul><li>y</ul>")]
    reference = list(pages[0])
    kids = main_text._children(reference)
    for page in pages:
        at = main_text.merge(reference, kids, page)
        assert len(set(at)) == len(page) and [reference[x][1] for x in at] == [label for _, label, _ in page]
        assert all(reference[x][0] == (at[parent] if parent >= 0 else -1) for x, (parent, _, _) in zip(at, page))
    assert [reference[x][1] for x in kids[1]] == ["h2", "p", "ul", "p"]


def test_tree_alignment_is_in_order():
    a = main_text.skeleton("<div><p>a</p><ul><li>x</ul><p>b</p></div>")
    b = main_text.skeleton("<div><p>a</p><p>b</p></div>")
    pairs = dict(main_text.align(a, b))
    assert [a[x][1] for x in sorted(pairs)] == ["", "div", "p", "#", "p", "#"]


def test_repeated_passages(docs, texts, empty):
    tokens = [(i, t, WORD.findall(t or "")) for i, t, _ in texts]
    starts = Counter(tuple(w[k : k + 35]) for _, _, w in tokens for k in range(len(w) - 34))
    want = Counter()
    for i, _, w in tokens:
        gone = {j for k in range(len(w) - 34) if starts[tuple(w[k : k + 35])] > 1 for j in range(k, k + 35)}
        want[i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)] += 1
    got = Counter((r.id, r.n_words, r.n_removed, r.kept) for r in repeated_passages.remove_repeats(docs).collect())
    assert got == want
    assert repeated_passages.remove_repeats(empty).count() == 0


def test_sharding(docs, empty):
    rows = sharding.assign(docs, shards=4).collect()
    assert len(rows) == docs.count()
    for shard in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))
    assert all(0 <= r.shard < 4 for r in rows) and {r.size for r in rows if r.id == 4} == {16}
    assert sharding.assign(empty, shards=4).count() == 0


def test_sharding_keeps_groups_that_fit_and_balances(spark):
    rng = random.Random(5)
    rows = [(i, f"text {i} " + "x" * rng.randrange(50, 150), None, 0, "") for i in range(3000)]
    for g, copies in enumerate((200, 90, 60, 40, 25, 12, 5, 2, 2)):
        rows += [(10_000 + 1000 * g + k, f"copies {g} " + "y" * 100, None, 0, "") for k in range(copies)]
    rows += [(50_000 + k, None, None, 0, "") for k in range(700)]
    got = sharding.assign(spark.createDataFrame(rows, DOCS), shards=10, rows_per_range=100).collect()
    assert len(got) == len(rows)
    sizes, homes, slots = {}, {}, {}
    for r in got:
        sizes[r.shard] = sizes.get(r.shard, 0) + r.size
        homes.setdefault(r.text_crc32, set()).add(r.shard)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(len(found) == 1 for found in homes.values())
    assert all(sorted(found) == list(range(len(found))) for found in slots.values())
    assert max(sizes.values()) - min(sizes.values()) <= 1200


def test_sharding_of_one_repeated_row(spark):
    rows = [(7, None, None, 0, "")] * 4000 + [(None, "a", None, 0, "")] * 500 + [(i, f"t{i}", None, 0, "") for i in range(100)]
    got = sharding.assign(spark.createDataFrame(rows, DOCS), shards=4).groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.max("slot").alias("last"), F.count_distinct("slot").alias("slots"), F.sum("size").alias("b")).collect()
    assert sum(r.n for r in got) == 4600 and all(r.n == r.slots == r.last + 1 for r in got)
    assert max(r.b for r in got) - min(r.b for r in got) < 1000


def test_sharding_places_whole_groups_first(spark):
    placed, loads = sharding.roomy_shards([(1, 60), (2, 60), (3, 60), (4, 40), (5, 30)], 2, 100)
    assert placed == {1: 0, 2: 1, 4: 0} | ({5: 1} if loads[1] == 90 else {}) and sum(loads) == 190 and 3 not in placed


def test_sharding_subdivides_a_hot_text(spark):
    rows = [(i, "same text" if i % 2 else words(3, i), None, 0, "") for i in range(3000)]
    got = sharding.assign(spark.createDataFrame(rows, DOCS), shards=10).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    assert len(got) == 10 and max(r.b for r in got) <= 1.05 * min(r.b for r in got)


def test_decontamination(spark, docs, empty):
    items = spark.createDataFrame([(1, words(40, 77)), (2, words(25, 78)), (3, None), (4, ""), (5, words(40, 79))], "item_id long, text string")
    planted = [(60, f"{words(300, 6)} {words(40, 77)} {words(20, 8)}", None, 0, ""), (61, words(25, 78).upper(), None, 0, ""), (62, " ".join(reversed(words(40, 79).split())), None, 0, "")]
    found = decontamination.matches(docs.unionByName(spark.createDataFrame(planted, DOCS)), items).collect()
    assert {(r.id, r.item) for r in found} == {(60, 1), (61, 2)}
    assert decontamination.matches(empty, items).count() == 0 and decontamination.matches(docs, items.limit(0)).count() == 0


def shingles(text, k):
    w = WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80)])
def test_similar_texts(spark, texts, empty, width, percent):
    base = words(120, 11).split()
    group = [(100 + i, " ".join(base[: i * 3 % 50] + [f"edit{i % 9}"] + base[i * 3 % 50 + 1 :]), None) for i in range(400)]
    rows = [*texts, *group]
    sets = [(i, shingles(t, width)) for i, t, _ in rows]
    label = list(range(len(sets)))
    find = lambda x: x if label[x] == x else find(label[x])
    for a, (_, x) in enumerate(sets):
        for b in range(a):
            y = sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y) and find(a) != find(b):
                label[find(a)] = find(b)
    least: dict = {}
    for a, (i, _) in enumerate(sets):
        least.setdefault(find(a), []).append(i)
    want = Counter((i, len(s), min((x for x in least[find(a)] if x is not None), default=None) if s else i) for a, (i, s) in enumerate(sets))
    frame = spark.createDataFrame([(i, t, lang, 0, "x") for i, t, lang in rows], DOCS)
    got = Counter((r.id, r.n_shingles, r.component_id) for r in similar_texts.similar(frame, width, percent).collect())
    assert got == want
    assert similar_texts.similar(empty, width, percent).count() == 0
    kept = similar_texts.representatives(frame, width, percent)
    assert kept.columns == frame.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id and r.doc_id < 13)[:2] == [1, 4]


def test_a_large_family_is_not_met_block_by_block(spark, monkeypatch):
    sent, original = spark.sparkContext.accumulator(0), similar_texts._joined

    def counted(percent):
        task = original(percent)

        def inner(table):
            sent.add(table.num_rows)
            return task(table)

        return inner

    monkeypatch.setattr(similar_texts, "_joined", counted)
    base, other = words(120, 11).split(), words(120, 12).split()

    def variant(of, i):
        return " ".join([*of[: i % 50], f"edit{i % 9}", *of[i % 50 + 1 :]])

    def found(rows):
        return {r.id: r.component_id for r in similar_texts.similar(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()}

    monkeypatch.setattr(similar_texts.links, "__defaults__", (16,))
    near = [(i, variant(base, i)) for i in range(400)]
    got = found(near)
    # Near copies of one text: each is sent a fixed number of times, however many there are.
    assert set(got.values()) == {0} and sent.value <= 3 * len(near)
    # A second group shares a third of the text; single texts link with few of either.
    mixed = near[:150] + [(1000 + i, variant(base[:40] + other[40:], i + 41)) for i in range(60)] + [(2000 + i, " ".join(base[: 60 + i])) for i in range(40)] + [(3000 + i, " ".join([*base[:30], *words(70, 300 + i // 2).split()])) for i in range(30)]
    sets = {i: shingles(t, 4) for i, t in mixed}
    label = {i: i for i in sets}
    for _ in range(len(sets)):
        before = dict(label)
        for a, x in sets.items():
            label[a] = min(label[b] for b, y in sets.items() if 100 * len(x & y) >= 85 * len(x | y))
        if label == before:
            break
    assert found(mixed) == label and len(set(label.values())) > 3


def test_byte_bpe_round_trip(docs, texts, empty):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    odd = ["é" * 300, "日本語 abc's\x1c\u0085 🎉", "a" * 3000 + " " * 40]
    bpe = byte_bpe.ByteBpe(path, P.PATTERN)
    assert all(list(bpe.encode(t)) == library.encode_ordinary(t) for t in odd)
    want = Counter((i, tuple(library.encode_ordinary(t or "")), (t or "").encode()) for i, t, _ in texts)
    coded = byte_bpe.round_trip(docs, path, P.PATTERN)
    assert Counter((r.id, tuple(r.ids), bytes(r.decoded)) for r in coded.collect()) == want
    assert byte_bpe.decode(coded, path, P.PATTERN, id_col="id").where(F.length("decoded") > 0).count() == sum(bool(t) for _, t, _ in texts)
    assert byte_bpe.encode(empty, path, P.PATTERN).count() == 0


def test_token_counts(docs, texts, empty):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    size = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    counter = token_counts.WordBpe(path)
    for t in ("Hello WORLD's 123", "a<|endoftext|>b <|x", "ÀÉ ΑΣ İ ß 日本語", ""):
        found = counter.counts(t)
        assert (int(found[-1]) if len(found) else 0) == size(t)
    assert counter.prefix_tokens("worldliness") == [size("worldliness"[:k]) for k in range(1, 12)]
    got = Counter((r.id, r.n_bytes, r.counts[-1] if r.counts else 0) for r in token_counts.prefix_counts(docs, path).collect())
    assert got == Counter((i, len((t or "").encode()), size(t or "")) for i, t, _ in texts)
    cut_off = {r.id: r.text for r in token_counts.truncate(docs, path, 5).collect()}
    assert all(size(t) <= 5 for t in cut_off.values()) and cut_off[4] == ""
    assert token_counts.prefix_counts(empty, path).count() == 0


def test_queries_and_pipeline(spark, tmp_path):
    import corpus_pipeline

    folder = str(tmp_path)
    rows = [(i, f"{words(40, i)} a{i}@b.org" if i % 3 else words(40, 1), ("en", "de")[i % 2], "s", 100) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, words(40, 7))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    held = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[1:4]:
        assert stage(spark, held, folder).columns == held.columns, name
    want = {i for i, t, *_ in rows if (i % 3 or i == 0) and i not in (1, 7)}  # 1 is a near copy of 0
    kept = corpus_pipeline.STAGES[2][1](spark, corpus_pipeline.STAGES[1][1](spark, held, folder), folder)
    assert {r.doc_id for r in kept.collect()} == want
    final = corpus_pipeline.STAGES[4][1](spark, corpus_pipeline.STAGES[3][1](spark, kept, folder), folder).collect()
    assert {r.doc_id for r in final} == want and all(r.n_tokens == len(r.ids) and len(r.decoded_sha256) == len(hashlib.sha256().hexdigest()) for r in final)
