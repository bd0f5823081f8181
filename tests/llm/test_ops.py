"""Each operator against a brute-force version, and on the awkward cases: nulls, empty and long texts, repeats, empty tables, extra columns."""

from __future__ import annotations

import base64
import hashlib
import os
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidelog.llm import chat, components, decontaminate, gru, html_text, license_scan, media, mixing, quality, records, simhash, toxicity
from tidelog.llm.simhash_kernel import fingerprint

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, *texts, first=0):
    """Rows of ``documents`` with ids from ``first``; a text may be an ``(id, text, source)`` triple."""
    rows = [t if isinstance(t, tuple) else (first + i, t, "s") for i, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


LONG = " ".join(f"word{i % 977}x{i % 13}" for i in range(60_000))


def prose(rng, n, pool=400):
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


# simhash


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ")
    for c in "\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_fingerprints_are_exact():
    rng = random.Random(1)
    for text in [None, "", " \t\n", "One", "Ünïcode É a b c d e", "a b c d", prose(rng, 50), LONG]:
        assert fingerprint(text) % 2**64 == plain_fingerprint(text)


def signed(fps):
    return sorted(f - 2**64 if f >> 63 else f for f in fps)


@pytest.mark.parametrize(("budget", "segment_bits"), [(4, 2), (4, 1), (2, 2)])
def test_links_against_all_pairs(spark, budget, segment_bits):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = set(base)
    for b in base:
        for _ in range(4):
            f = b
            for bit in rng.sample(range(64), rng.randrange(1, 8)):
                f ^= 1 << bit
            fps.add(f)
    fps = signed(fps)
    got = {(r.u, r.v) for r in simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), budget, segment_bits).collect()}
    pairs = {(a, b) for a in fps for b in fps if a < b and ((a ^ b) % 2**64).bit_count() <= budget}
    assert got <= pairs and plain_components(fps, got) == plain_components(fps, pairs)
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "fp long"), 3)


def test_links_of_dense_groups(spark):
    """Near copies that differ in few bits: components as of all pairs, at rows in proportion to the group."""
    rng, fps = random.Random(19), set()
    for size in (3, 10, 50, 500, 5000):
        base, active, group = rng.getrandbits(64), rng.sample(range(64), 24), set()
        while len(group) < size:
            f = base
            for bit in rng.sample(active, rng.choice([1, 2, 3, 5, 9, 12])):
                f ^= 1 << bit
            group.add(f)
        fps |= group
    fps = signed(fps)
    rows = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()
    want, left = {}, np.array(fps, np.int64)
    while len(left):  # what is reached from the least node left, over all pairs
        reached, wave, left = [int(left[0])], [left[0]], left[1:]
        while wave:
            near = np.bitwise_count((left ^ wave.pop()).view(np.uint64)) <= 4
            wave += list(left[near])
            reached += left[near].tolist()
            left = left[~near]
        want |= dict.fromkeys(reached, reached[0])
    assert plain_components(fps, {(r.u, r.v) for r in rows}) == want
    assert all(((r.u ^ r.v) % 2**64).bit_count() <= 4 for r in rows)
    assert len(rows) <= len(fps) * (2 * 70 * simhash.HUBS + 2081)


def test_spots_with_many_components_go_to_meeting_points(spark, monkeypatch):
    """Nodes that share a half and lie apart in pairs, so that no few hubs settle their spot."""
    rng = random.Random(18)
    called = []
    plain = simhash._through_points
    monkeypatch.setattr(simhash, "_through_points", lambda *a: called.append(1) or plain(*a))
    half, fps = rng.getrandbits(32) << 32, set()
    for _ in range(60):
        f = half | rng.getrandbits(32)
        fps |= {f, f ^ 1 << rng.randrange(32) ^ 1 << rng.randrange(32)}
    fps = signed(fps)
    got = {(r.u, r.v) for r in simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()}
    pairs = {(a, b) for a in fps for b in fps if a < b and ((a ^ b) % 2**64).bit_count() <= 4}
    assert called and got <= pairs and plain_components(fps, got) == plain_components(fps, pairs)


def test_codes_differ_as_bit_counts_do(spark):
    rng = random.Random(16)
    fps = signed({rng.getrandbits(64) for _ in range(50)})
    codes = [r[0] % 2**64 for r in spark.createDataFrame([(f,) for f in fps], "fp long").select(simhash.embedded(F.col("fp"))).collect()]
    counts = [[(f >> at & 3).bit_count() for at in range(0, 64, 2)] for f in fps]
    for a, x in zip(codes, counts):
        for b, y in zip(codes, counts):
            assert (a ^ b).bit_count() == sum(abs(i - j) for i, j in zip(x, y))


def plain_components(nodes, edges):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (500, 400)]
    got = {r.u: r.v for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = plain_components({n for e in edges for n in e}, edges)
    assert got == {n: c for n, c in want.items() if n != c}


def test_near_duplicates_of_awkward_rows(spark):
    rng = random.Random(3)
    text = prose(rng, 400)
    near = text.replace(text.split()[200], "changed", 1)
    rows = documents(spark, text, near, text, None, "", prose(rng, 300), (None, text, "s"), (2, text, None), LONG).withColumn("component_id", F.lit("clash")).withColumn("fp", F.lit(0))
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.fingerprint, r.component_id) for r in simhash.near_duplicates(rows).collect())
    assert got[0][3] is None and len(got) == 9
    by = {r[1]: r[3] for r in got[1:]}
    assert (fingerprint(text) ^ fingerprint(near)).bit_count() <= 4
    assert by == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5, 8: 8}
    assert {r[2] for r in got if r[1] in (3, 4)} == {"0" * 16}
    kept = simhash.one_of_each(rows)
    assert kept.columns == rows.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["0", "3", "5", "8", "None"]
    assert simhash.near_duplicates(rows.limit(0)).count() == 0


# license scan


def test_license_scan_finds_what_all_windows_hold(spark):
    rng = random.Random(4)
    filler = lambda n: prose(rng, n)
    mit = license_scan.TEMPLATES["MIT-text"]
    edited = mit.replace("copyright", "copy").replace("sublicense", "sub")
    texts = [
        f"{filler(80)}\nReleased under the MIT License.\n{filler(50)}", f"{filler(10)} {mit} {filler(33)}", f"{filler(500)} {edited}", filler(200), None, "", mit[:200],
        "licensed UNDER cc by-nc 4.0", LONG + " This work is licensed under the GNU General Public License, version 3.", filler(7) + " Released under a MIT License.",
    ]
    rows = documents(spark, *texts, (0, texts[0], "s"), (None, texts[0], "s")).withColumn("license", F.lit(1)).withColumn("w", F.lit(2))
    got = {(r.doc_id, r.license): r.containment for r in license_scan.scan(rows).collect()}
    words = lambda t: "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()
    grams = lambda w: [" ".join(w[i : i + 5]) for i in range(len(w) - 4)]
    want = {}
    for i, t in [*enumerate(texts), (None, texts[0])]:
        have = grams(words(t))
        for name, template in license_scan.TEMPLATES.items():
            g = grams(words(template))
            size = len(g) + license_scan.stride(len(g)) - 1
            best = max((len(set(g) & set(have[a : a + size])) / len(set(g)) for a in range(0, len(have), license_scan.stride(len(g)))), default=0)
            if best >= 0.8:
                want[i, name] = best
    assert got == pytest.approx(want) and {n for _, n in got} >= {"MIT", "MIT-text", "GPL-3.0", "CC-BY-NC-4.0"}
    assert license_scan.scan(rows.limit(0)).count() == 0
    with pytest.raises(ValueError):
        license_scan.scan(rows, {"short": "too few words"})


@pytest.mark.parametrize("doc_id", [1, None])
def test_rows_of_one_id_are_scanned_each(spark, doc_id):
    mit = license_scan.TEMPLATES["MIT-text"]
    part = mit[: len(mit) * 55 // 100]
    for texts in ([part, mit, None], [None, mit, part], [part, mit, mit, part]):
        rows = documents(spark, *[(doc_id, t, "s") for t in texts])
        assert [tuple(r) for r in license_scan.scan(rows).where("license = 'MIT-text'").collect()] == [(doc_id, "MIT-text", 1.0, 0)]


def test_a_text_of_a_million_words_is_scanned(spark):
    rng = random.Random(17)
    text = prose(rng, 600_000) + " " + license_scan.TEMPLATES["ISC"] + " " + prose(rng, 400_000) + " Released under the MIT License."
    got = {r.license: r for r in license_scan.scan(documents(spark, text)).collect()}
    assert set(got) == {"ISC", "MIT"} and got["ISC"].containment == got["MIT"].containment == 1
    assert abs(got["ISC"].first_word - 600_000) <= 10


# decontamination


def plain_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_myers_distance():
    rng = random.Random(5)
    for _ in range(400):
        item = "".join(rng.choices("abc", k=rng.randint(1, 80)))
        text = "".join(rng.choices("abc", k=rng.randint(0, 90)))
        k = rng.randint(0, len(item))
        assert decontaminate.least_distance(decontaminate.letters(item), len(item), text, k) == min(plain_distance(item, text), k + 1)


def test_leaks_against_brute_force(spark):
    rng = random.Random(6)
    items = [prose(rng, n, 60) for n in (3, 20, 30, 30)]
    spoiled = lambda s, n: "".join(c if i % (len(s) // n) else "#" for i, c in enumerate(s, 1))
    texts = [
        items[1].upper() + " tail", prose(rng, 40) + "\n" + items[2].replace(" ", "\n") + " more", spoiled(items[3], 7), spoiled(items[3], 25), prose(rng, 90), None, "",
        LONG + items[1] + LONG, items[0] + " " + items[3][1:],
    ]
    rows = documents(spark, *texts, (0, texts[0], None), (None, texts[0], "s")).withColumn("item_id", F.lit("x")).withColumn("distance", F.lit("x"))
    bench = spark.createDataFrame([*enumerate(items), (1, items[1]), (9, ""), (8, None), (None, items[0])], "item_id long, text string")
    got = sorted((str(r.doc_id), r.item_id, r.distance) for r in decontaminate.leaks(rows, bench).collect())
    want = []
    for i, t in [*enumerate(texts), (0, texts[0]), (None, texts[0])]:
        for n, item in enumerate(items):
            part = decontaminate.normal(t)
            part = part if len(part) < 5000 else part[len(part) // 2 - 500 : len(part) // 2 + 500]
            d = plain_distance(decontaminate.normal(item), part)
            if d <= decontaminate.budget(item):
                want.append((str(i), n, d))
    assert got == sorted(want) and len(got) > 5
    clean = decontaminate.without_leaks(rows, bench)
    assert clean.columns == rows.columns
    found = {i for i, _, _ in want}
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(i) for i in range(9) if str(i) not in found)
    assert decontaminate.leaks(rows.limit(0), bench).count() == 0 and decontaminate.leaks(rows, bench.limit(0)).count() == 0
    assert decontaminate.without_leaks(rows, bench.limit(0)).count() == rows.count()


def test_items_come_in_blocks(spark):
    bench = spark.createDataFrame([(i, f"item number {i} of the test") for i in range(10)], "item_id long, text string")
    blocks = list(decontaminate.blocks(bench, 60))
    assert len(blocks) > 3 and [i for b in blocks for i, _ in b] == list(range(10))


# mixing


def plain_targets(sizes):
    """Water-filling by repeated sharing."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, full, total = {}, set(), sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in full]
        left = total - sum(3 * sizes[s] for s in full)
        target = {s: 3 * sizes[s] if s in full else left * weight[s] / sum(weight[o] for o in open_) for s in names}
        over = {s for s in open_ if target[s] > 3 * sizes[s]}
        if not over:
            return target
        full |= over


def test_mixture(spark):
    rng = random.Random(7)
    rows = [(i, prose(rng, int(rng.paretovariate(1.1) * 8) % 900), rng.choice(["big", "big", "big", "b", "é", None, "Z"])) for i in range(1500)]
    rows += [(5000 + i, "a b c", "same") for i in range(300)] + [(6000, "x y", "tiny"), (6001, None, "zero"), (6002, "", "zero"), (None, "n u l l", "b"), (0, rows[0][1], rows[0][2])]
    docs = documents(spark, *rows).withColumn("size", F.lit("clash")).withColumn("taken", F.lit("clash"))
    sized = mixing.sizes(docs).drop("taken")
    got = mixing.mixture(sized).collect()
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    want = plain_targets(size)
    taken = {}
    for r in got:
        assert r.taken == r.copies * r["size"] <= 3 * r["size"] and r.source_size == size[r.source]
        assert r.target == pytest.approx(want[r.source])
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(3, 0.002 * t), s
    assert want["tiny"] == 6 and len(got) == len(rows)
    again = mixing.mixture(sized.repartition(7)).collect()
    key = lambda r: (str(r.doc_id), str(r.source), r["size"], r.copies)
    assert sorted(map(key, got)) == sorted(map(key, again))
    copied = mixing.mixed(docs)
    assert copied.columns == docs.columns and copied.count() == sum(r.copies for r in got)
    assert mixing.mixture(sized.limit(0)).count() == 0


def test_crowded_cells_are_cut_into_strata(spark, monkeypatch):
    monkeypatch.setattr(mixing, "STRATUM", 50)
    docs = documents(spark, *[(i, "a b c d", "hot" if i < 600 else f"s{i % 3}") for i in range(900)])
    got = mixing.mixture(mixing.sizes(docs)).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect()
    assert all(abs(r.t - r.g) <= 4 for r in got)


# token records


def test_records_round_trip(spark):
    path = public_tokenizers.path(records.VOCABULARY)
    plain = Tokenizer.from_file(path)
    texts = ["Hello World, it's 2024!", None, "", "  ", "Ünïcode  é x\x1cy", "<|endoftext|> a<|startoftext|>b", "漢字 \U0001f600", LONG, "Hello World, it's 2024!"]
    rows = documents(spark, *texts, (3, "again", "s"), (None, "no id", "s"), (-5, "negative", "s")).withColumn("file", F.lit(0)).withColumn("offset", F.lit(0)).repartition(3)
    got = records.encoded(rows)
    listed = sorted(got.collect(), key=lambda r: r.start)
    assert [r.doc_id for r in listed] == [None, -5, 0, 1, 2, 3, 3, 4, 5, 6, 7, 8]
    start = 0
    want = {}
    for i, t in [*enumerate(texts), (3, "again"), (None, "no id"), (-5, "negative")]:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [2]
        want.setdefault(i, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    for r in listed:
        assert r.start == start and (r.n_tokens, r.ids_crc32) in want[r.doc_id]
        start += r.n_tokens
    some = listed[4]
    doc_id, ids = records.read_at(spark, some.file, some.offset, some.length)
    assert doc_id == some.doc_id and len(ids) == some.n_tokens and ids[-1] == 2
    assert records.encoded(rows.limit(0)).count() == 0


def test_damaged_records_are_noticed():
    good = records.frame(records.pack(7, b"\x01\x00\x02\x00", 2))
    assert records.unpack(records.unframe(good, 0)[0])[1].tolist() == [1, 2]
    for at in (0, 9, 14, len(good) - 3):
        with pytest.raises(ValueError):
            records.unframe(good[:at] + bytes([good[at] ^ 1]) + good[at + 1 :], 0)


def test_encoder_starts_anew(monkeypatch):
    path = public_tokenizers.path(records.VOCABULARY)
    small, plain = records.Encoder(path, capacity=3), Tokenizer.from_file(path)
    for text in ["a b c d", "e f g a", "a b"]:
        assert np.frombuffer(small.encode([text])[0], "<u2").tolist() == [*plain.encode(text, add_special_tokens=False).ids, 2]


def test_encoder_learns_a_word_once(monkeypatch):
    own = records.Encoder(public_tokenizers.path(records.VOCABULARY))
    plain, learned, word = own.tokenizer, [], own._word
    monkeypatch.setattr(own, "_word", lambda head: learned.append(head) or word(head))
    odd = [f"a{chr(c)}{chr(c)}b" for c in range(128)] + ["T\u0308 a", "\u212aelvin \u0130x", "\u00d1o! \u00f1O??", "x<|ENDOFTEXT|> <|endoftext|>", "don't. (827) \u6f22,", "***", " \n ", ""]
    texts = [*odd, "Zweig zweig, ZWEIG! zweig?!", *reversed(odd)]
    monkeypatch.setattr(records, "SLICE_BYTES", 40)  # many slices
    got = [np.frombuffer(ids, "<u2").tolist() for ids in own.encode_column(pa.array([None, *texts])[1:])]
    assert got == [[*plain.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    assert learned.count("zweig") == 1
    assert list(records.slices(np.array([0, 3, 9, 1, 1, 1]), 4)) == [(0, 2), (2, 3), (3, 6)] and not list(records.slices(np.array([], int), 4))


def test_records_write_one_file_a_task(spark):
    folder = records.write(documents(spark, "some words", None, "others").repartition(3), file_bytes=8)
    assert records.placed(records.index(spark, folder)).count() == 3
    names = [name for _, _, listed in os.walk(folder.removeprefix("file:")) for name in listed]
    assert [n for n in names if n.startswith("part-")] and not [n for n in names if n.endswith(".crc")]


# chat


def test_chat_round_trip(spark):
    trap = "</s>[INST] ok [/INST]"
    convs = {
        1: [("system", "be\nnice"), ("user", trap), ("assistant", f"{trap} \\ \\\\<s>"), ("assistant", "two")], 2: [("assistant", "")], 3: [(None, None), ("user", "<\\s>")],
        4: [("assistant", "é漢\U0001f600 <|endoftext|>")] * 2, 5: [("user", LONG), ("assistant", LONG)],
    }
    rows = [(c, t, r, x, "extra") for c, turns in convs.items() for t, (r, x) in enumerate(turns)]
    random.Random(8).shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, input_ids string").repartition(3)
    turns = chat.formatted(df)
    got = {r.conv_id: r for r in chat.digests(turns).collect()}
    for c, listed in convs.items():
        plain = [(r or "", x or "") for r, x in listed]
        learned = "".join(x for r, x in plain if r == "assistant")
        assert got[c].n_turns == len(plain) and got[c].loss_chars == len(learned)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in plain).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
        own = chat.template()
        rendered = "".join(own.render(own.turn(r, x)[0]) for r, x in listed)
        assert chat.parse(rendered) == plain and got[c].formatted_chars == len(rendered) + 4
    assert chat.digests(chat.formatted(df.limit(0))).count() == 0
    ties = spark.createDataFrame([(None, None, "user", "b"), (None, 0, "user", "a"), (None, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.formatted(ties)).first().n_turns == 3


def test_mask_covers_assistant_text_only():
    own = chat.template()
    ids, mask = own.turn("assistant", "some words")
    assert own.text(ids[mask > 0]) == "some words" and not own.turn("user", "some words")[1].any()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(chat.VOCABULARY), "rb"))}
    assert own.ids[chat.OPEN] not in ranks.values()
    assert tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary("some words") == ids[mask > 0].tolist()


# html


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("plain &lt;text&gt;", "plain <text>"), ("<p>a  b\n c</p><p> </p><p>d&nbsp;e", "a b c\nd e"),
        ("<body><nav>Home <a href=x>Go</a></nav><article><h1>T</h1><p>One <b>bold</b> line.<br><p>Two</article><footer>f</footer>", "T\nOne bold line.\nTwo"),
        ("<article><p>Keep &amp; this &eacute; &#233; &copy</p><script>if (a<b) '</p>'</script><section class='user-comments'><p>nice</p></section><form>x</form></article>", "Keep & this é é ©"),
        ("<div id=sidebar><p>long long long long long text</p></div><main><p>Short.</p></main>", "Short."),
        ("<p>unclosed <!-- never closed", "unclosed"), ("<p>a <scr", "a"), ("<ul><li>one<li>two</ul>", "one\ntwo"), ("<table><tr><td>1<td>2</table>", "1\n2"),
        ("<div class='with-sidebar'><h1>T</h1><p>One.</p><p>Two.</p><div class='sidebar'><p>x</p></div></div>", "T\nOne.\nTwo."),
        ("<div class=header><h1>Site</h1></div><p>Text of the page.</p>", "Text of the page."), ("<div class=nav-on><main><p>In.</p></main></div>", "In."),
        ("<div class='cookie-notice'>we use</div><div class='reading'>Text of the page here.</div>", "Text of the page here."),
    ],
)
def test_main_text(page, text):
    assert html_text.main_text(page) == text


def test_links_lose_against_prose():
    links = "".join(f"<li><a href=/{i}>menu entry number {i}</a></li>" for i in range(40))
    prose_ = "".join(f"<p>Paragraph {i} has a sentence that says something about the matter at hand.</p>" for i in range(5))
    got = html_text.main_text(f"<body><div><ul>{links}</ul></div><div>{prose_}</div></body>")
    assert got.count("\n") == 4 and "menu" not in got


@pytest.mark.parametrize("tag", ["section", "div"])
@pytest.mark.parametrize("menu", ["", "<div><ul>" + "<li><a href=/x>an entry of the menu</a></li>" * 12 + "</ul></div>"])
def test_articles_of_several_sections_stay_whole(tag, menu):
    parts = [[f"Part {k} paragraph {i} " + "says some more of it " * 14 for i in range(10)] for k in range(2)]
    items = [f"Entry {i} of the list holds a few words" for i in range(150)]
    body = "".join(f"<{tag}>" + "".join(f"<p>{p}</p>" for p in part) + f"</{tag}>" for part in parts)
    sections = f"{menu}<article><h1>Head</h1>{body}<p>End.</p></article>"
    listed = f"{menu}<div><h1>Head</h1><p>{parts[0][0]}</p><ul>{''.join(f'<li>{x}</li>' for x in items)}</ul><p>{parts[1][0]}</p></div>"
    assert html_text.main_text(sections).split("\n") == ["Head", *(p.strip() for part in parts for p in part), "End."]
    assert html_text.main_text(listed).split("\n") == ["Head", parts[0][0].strip(), *items, parts[1][0].strip()]
    within = f"<div>{menu}{body}{menu}</div>"
    assert html_text.main_text(within).split("\n") == [p.strip() for part in parts for p in part]


def test_forms_that_hold_the_page_are_kept():
    page = "<h1>T</h1><p>One line.</p><p>Two lines.</p><select><option>x</option></select><form><p>Your name</p><input></form>"
    for tag in ("form", "header", "aside"):
        assert html_text.main_text(f"<body><{tag}>{page}</{tag}></body>") == "T\nOne line.\nTwo lines."
    assert html_text.main_text("<body><form><main><p>In.</p></main></form></body>") == "In."
    assert html_text.main_text("<form><h1>Sign up</h1><p>Name</p></form><p>Text of the page.</p>") == "Text of the page."


def test_sibling_blocks_of_one_article_stay():
    block = lambda k, n: "<div>" + "".join(f"<p>Section {k} line {i} " + "goes on about the matter for some time " * 4 + "</p>" for i in range(n)) + "</div>"
    got = html_text.main_text(f"<body><h1>Title</h1><div>A lead that says in a few words what the piece is about.</div>{block(1, 5)}{block(2, 4)}</body>").split("\n")
    assert got[:2] == ["Title", "A lead that says in a few words what the piece is about."] and len(got) == 11


def test_an_article_is_kept_whatever_its_class():
    assert html_text.main_text('<article class="post-comment-free"><p>One.</p><p>Two.</p></article>') == "One.\nTwo."
    two = "<article><p>Text of the page.</p></article><article class=comment><p>nice</p></article>"
    assert html_text.main_text(two) == "Text of the page."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<p class=it's>Hello</p><p>we don't</p><p>tail</p>", "Hello\nwe don't\ntail"), ("<p title='a > b' class=\"x\">one</p><p>two</p>", "one\ntwo"),
        ('<p title="class=sidebar">kept</p><p>two</p>', "kept\ntwo"), ("<p =x y = z / >one</p>", "one"), ('<p class="never closed>a</p><p>b</p>', "a\nb"), ("<br/>x<p/>y", "x\ny"),
    ],
)
def test_attributes(page, text):
    assert html_text.main_text(page) == text


def test_extracted_rows(spark):
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    rows = spark.createDataFrame([(1, "u", "<p>x</p>", "q"), (1, "u", "<p>x</p>", "q"), (None, None, None, None), (3, "v", deep, "q")], "page_id long, url string, html string, text string")
    got = sorted((str(r.page_id), r.text, r.n_chars) for r in html_text.extracted(rows).collect())
    assert got == [("1", "x", 1), ("1", "x", 1), ("3", "deep", 4), ("None", "", 0)]
    assert html_text.extracted(rows.limit(0)).count() == 0


# media


def test_media_round_trip(spark):
    texts = ["a", None, "", "x" * 64, "é漢" * 50, LONG, "a"]
    rows = documents(spark, *texts, (None, "a", "s")).withColumn("media", F.lit(1))
    got = {str(r.doc_id): r for r in media.described(rows).collect()}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        padded = data + bytes(-len(data) % 64 if data else 64)
        r, wav = got[str(i)], media.to_wav(padded)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(data), len(padded), hashlib.sha256(padded).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(padded[-64:]), len(wav), hashlib.sha256(wav).hexdigest())
        assert media.from_wav(wav) == padded and len(r.times) == len(r.codes)
    assert got["0"].codes == got["6"].codes == got["None"].codes
    assert len(got["5"].times) > 100 and got["5"].times == sorted(got["5"].times)
    assert media.described(rows.limit(0)).count() == 0


def test_peak_pairs_hold_in_blocks(monkeypatch):
    data = LONG.encode()[: 64 * 900]
    whole = media.pairs(data)
    monkeypatch.setattr(media, "BLOCK", 7)
    assert all(np.array_equal(a, b) for a, b in zip(whole, media.pairs(data)))


def test_a_tone_peaks_at_its_bin():
    t = np.arange(media.FRAME * 8)
    tone = np.where(t < media.FRAME * 4, 128 + 100 * np.sin(2 * np.pi * 32 * t / media.FRAME), 128).astype(np.uint8).tobytes()
    bins, powers = media.band_peaks(tone)
    assert bins[2, 1] == 32 and powers[2, 1] > 50 * powers[-1, 1]


# quality and toxicity


def labelled(spark, n=400):
    rng = random.Random(9)
    rows, marks = [], []
    for i in range(n):
        bad, toxic = rng.random() < 0.3, rng.random() < 0.3
        words = [rng.choice(["the", "house", "green", "walks", "slowly", "river"]) + rng.choice(["", "s", "er"]) for _ in range(rng.randrange(20, 300))]
        if toxic:
            words[rng.randrange(len(words))] = "vile" + rng.choice(["ness", "st", "ly"])
        text = "".join(w + (rng.choice(["### ", "*** ", "$$$ "]) if bad else " ") for w in words)
        rows.append((i, text, "s"))
        marks.append((i, int(not bad), int(toxic)))
    rows += [(None, "null id", "s"), (9000, None, "s"), (9001, "", "s"), (0, rows[0][1], "s"), (9002, LONG, "s")]
    marks += [(None, 1, 1), (9000, None, None), (0, marks[0][1], marks[0][2])]
    return documents(spark, *rows).withColumn("score", F.lit("clash")), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("module", "label", "modulus", "fold", "threshold"), [(quality, "quality", 5, 0, 0.3), (toxicity, "toxic", 3, 1, 0.7)])
def test_scores(spark, module, label, modulus, fold, threshold):
    docs, marks = labelled(spark)
    got = module.score_documents(docs, marks).collect()
    truth = {r.doc_id: r[label] for r in marks.collect() if r[label] is not None}
    assert len(got) == docs.count()
    right = []
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= threshold)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % modulus == fold)
        if r.held_out and r.doc_id in truth:
            right.append(r.predicted == truth[r.doc_id])
    assert np.mean(right) > 0.95 and len(right) > 40
    swapped = marks.where((F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus) != fold)
    key = lambda r: (str(r.doc_id), r.score)
    assert sorted(map(key, got)) == sorted(map(key, module.score_documents(docs, swapped).collect()))
    assert module.score_documents(docs.limit(0), marks).count() == 0
    assert module.score_documents(docs, marks.limit(0)).count() == docs.count()


def test_without_toxic_keeps_columns(spark):
    docs, marks = labelled(spark, 200)
    kept = toxicity.without_toxic(docs, marks)
    assert kept.columns == docs.columns and 100 < kept.count() < docs.count()


def test_windows_cover_every_word():
    for n in (0, 1, gru.WINDOW, gru.WINDOW + 1, 1000):
        windows = gru.windows_of(np.arange(n, dtype=np.int32))
        assert set(windows.ravel()) - {-1} == set(range(n)) and len(windows) >= 1


def test_scores_do_not_depend_on_batches_or_pieces():
    w = gru.initial(0)
    rng = random.Random(10)
    texts = [prose(rng, n, 5000) for n in (0, 3, 64, 65, 700, 9500)]
    whole = gru.Scorer(w).logits(texts)
    alone = np.concatenate([gru.Scorer(w, capacity=50).logits([t]) for t in texts])
    assert np.allclose(whole, alone, atol=1e-5)
    vocabulary = sorted({x for t in texts for x in gru.words_of(t)})
    number = {x: i for i, x in enumerate(vocabulary)}
    for t, z in zip(texts, whole):
        windows = gru.windows_of(np.array([number[x] for x in gru.words_of(t)], np.int32))
        assert gru.score(w, windows, vocabulary).max() == pytest.approx(z, abs=1e-5)


def test_long_words_are_read_to_their_end():
    rng = random.Random(15)
    w = gru.initial(0)
    for n in (63, 64, 65, 124, 125, 4000, 60_000):
        word = "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(n))
        pieces = [x.decode() for x in gru.words_of(f"a {word} b")]
        assert pieces[0] == "a" and pieces[-1] == "b" and all(len(x) <= gru.WORD_CHARS for x in pieces)
        assert pieces[1] + "".join(x[max(gru.GRAM_SIZES) - 1 :] for x in pieces[2:-1]) == word
        grams = {word[i : i + k] for k in gru.GRAM_SIZES for i in range(n - k + 1)}
        assert grams <= {x[i : i + k] for x in pieces for k in gru.GRAM_SIZES for i in range(len(x) - k + 1)}
    # what stands behind the first characters of a run reaches the vectors by its n-grams
    clean, bad = "".join(chr(0x4E00 + i) for i in range(500)), "".join(chr(0x9000 + i) for i in range(20))
    rows = [{int(r) for x in gru.words_of(t) for r in gru.gram_rows([x])[0]} for t in (clean, clean + bad)]
    assert len(rows[1] - rows[0]) >= 50


def test_gradients_against_differences():
    rng = np.random.default_rng(0)
    w = gru.Weights(*(x.astype(np.float64) for x in gru.initial(1).each()))
    vectors, there = rng.standard_normal((5, 3, gru.INPUT)), np.ones((5, 3))
    there[3:, 1] = 0
    target, weight = np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])
    _, d_vectors, dense = gru.gradients(w, vectors, there, target, weight)
    for params, grad in [*zip(w.each()[2:], dense), (vectors, d_vectors * there[:, :, None])]:
        for at in [tuple(rng.integers(0, n) for n in params.shape) for _ in range(4)]:
            if params is vectors and not there[at[:2]]:
                continue
            kept, step = params[at], 1e-3
            params[at] = kept + step
            up = gru.gradients(w, vectors, there, target, weight)[0]
            params[at] = kept - step
            down = gru.gradients(w, vectors, there, target, weight)[0]
            params[at] = kept
            assert grad[at] == pytest.approx((up - down) / (2 * step), rel=0.05, abs=2e-4)


def test_shared_folder_follows_the_session():
    from types import SimpleNamespace

    from tidelog.llm.common import shared_folder

    session = lambda master, root: SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: root), sparkContext=SimpleNamespace(master=master))
    assert shared_folder(session("spark://x", "hdfs://x/shared/"), "t").startswith("hdfs://x/shared/t-")
    assert shared_folder(session("local[4]", None), "t").startswith("file:///")
    with pytest.raises(ValueError):
        shared_folder(session("spark://x", None), "t")


def test_training_samples_are_bounded_in_bytes(spark):
    from tidelog.llm.common import labelled_texts

    docs, marks = labelled(spark)
    whole = labelled_texts(docs, marks, "toxic", 3, 1, 50).collect()
    some = labelled_texts(docs, marks, "toxic", 3, 1, 50, 10_000).collect()
    for label in (0, 1):
        every, taken = ([r for r in rows if r.label == label] for rows in (whole, some))
        assert set(taken) < set(every) and len(every) == 50
        assert 10_000 <= sum(len(r.text) for r in taken) < 10_000 + max(len(r.text) for r in every)
