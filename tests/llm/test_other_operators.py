"""Images, chats, urls and the pipeline."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from chunkweave.llm import chat, media, meetings, minhash, nbsvm, quality_rules, secret_scan, urlfilter
from chunkweave.session import Scratch, table
from tests.llm.test_text_operators import brute_base, brute_components, brute_features


# --- 2: images ---------------------------------------------------------------------------


def drawings(n, seed=1):
    rng = np.random.default_rng(seed)
    return [media.render(rng.normal(size=64).astype(np.float32)) for _ in range(n)]


def test_png_round_trip_and_filters():
    import struct
    import zlib

    grey = drawings(1)[0].astype(np.uint8)
    assert (media.decode(media.encode_png(grey)) == grey).all()
    h, w = 5, 7
    rgb = np.random.default_rng(0).integers(0, 256, (h, w, 3)).astype(np.uint8)
    for how in range(5):
        rows, above = [], np.zeros(w * 3, np.int32)
        for r in range(h):
            cur = rgb[r].reshape(-1).astype(np.int32)
            left = np.concatenate((np.zeros(3, np.int32), cur[:-3]))
            corner = np.concatenate((np.zeros(3, np.int32), above[:-3]))
            p = left + above - corner
            da, db, dc = abs(p - left), abs(p - above), abs(p - corner)
            paeth = np.where((da <= db) & (da <= dc), left, np.where(db <= dc, above, corner))
            add = [0, left, above, (left + above) // 2, paeth][how]
            rows.append(bytes([how]) + ((cur - add) & 255).astype(np.uint8).tobytes())
            above = cur
        chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + b"\0\0\0\0"
        data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(rows))) + chunk(b"IEND", b"")
        assert np.allclose(media.decode(data), rgb.astype(np.float32) @ np.array([0.299, 0.587, 0.114], np.float32))
    assert media.decode(b"P5\n# note\n2 1\n255\n\x01\x02").tolist() == [[1, 2]]
    part = lambda k, b: struct.pack(">I", len(b)) + k + b + b"\0\0\0\0"
    png = lambda w, h, colour, *parts: b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)) + b"".join(parts) + part(b"IEND", b"")
    pixels = part(b"IDAT", zlib.compress(b"\0\1" * 2))
    broken = [png(1, 2, 3, pixels), png(1, 2, 7, pixels), png(1 << 30, 1 << 30, 0, pixels), png(9, 9, 0, pixels), png(1, 2, 0), png(1, 2, 3, part(b"PLTE", b"\0"), pixels)]
    bomb = png(4, 4, 0, part(b"IDAT", zlib.compress(b"\0" * 50_000_000)))
    assert media.decode(bomb).tolist() == [[0.0] * 4] * 4
    for bad in (None, b"", b"junk", b"\x89PNG\r\n\x1a\nxx", b"P5\n2 2\n255\n\x01", b"P5 12", b"P5", b"P5 #", b"P6 1 1 255", b"P5 0 1 255 ", b"P5 99999999 99999999 255 x", *broken):
        assert media.decode(bad) is None


EDITS = {
    "brighten": lambda g: np.rint(g * 0.8 + 25), "crop": lambda g: media.edited(g, 0), "turn": np.rot90, "caption": lambda g: media.edited(g, 2), "noise": lambda g: np.clip(np.rint(g + np.random.default_rng(1).normal(0, 6, g.shape)), 0, 255),
    "resize 0.9": lambda g: resized(g, 0.9), "resize 0.85": lambda g: resized(g, 0.85), "resize 0.75": lambda g: resized(g, 0.75), "resize 0.66": lambda g: resized(g, 0.66), "resize 0.5": lambda g: resized(g, 0.5), "half": lambda g: g[24:72, 24:72], "two thirds": lambda g: g[16:80, 16:80],
}


def resized(g, scale):
    return np.clip(np.rint(media._resize(g[None].astype(float), scale)[0]), 0, 255)


def test_recall_of_each_edit(spark):
    """Each edit of thirty drawings, found through the whole operator; unrelated drawings stay apart."""
    n, names = 30, list(EDITS)
    rows = [(100 * k, media.encode_png(g)) for k, g in enumerate(drawings(n, 5))]
    rows += [(100 * k + 1 + j, media.encode_png(np.ascontiguousarray(EDITS[e](g)))) for k, g in enumerate(drawings(n, 5)) for j, e in enumerate(names)]
    got = {r["image_id"]: r["component_id"] for r in media.find_copies(spark, spark.createDataFrame(rows, "image_id long, image binary")).collect()}
    assert all(got[i] // 100 == i // 100 for i in got)
    recall = {e: sum(got[100 * k + 1 + j] == got[100 * k] for k in range(n)) / n for j, e in enumerate(names)}
    print(recall)
    assert min(recall.values()) >= 0.9, recall


def test_links_off_the_centres_of_a_shared_logo(spark):
    """Copies of the middle of the id order, in buckets that every image shares through a logo."""
    logo = drawings(1, 77)[0][:40, :40]
    rows = []
    for k, g in enumerate(drawings(24, 9)):
        a = g.copy()
        a[:40, :40] = logo
        rows.append((10 * k, media.encode_png(a)))
        if 8 <= k < 16:
            rows.append((10 * k + 1, media.encode_png(np.rint(a * 0.8 + 25))))
    got = {r["image_id"]: r for r in media.find_copies(spark, spark.createDataFrame(rows, "image_id long, image binary")).collect()}
    assert all(got[10 * k + 1]["component_id"] == got[10 * k]["component_id"] for k in range(8, 16))


def arranged(n, seed):
    """Images of the same six tiles in other places: their words are the same, only where they lie differs."""
    rng, tiles, out = np.random.default_rng(seed), [g[30:52, 30:52] for g in drawings(6, 41)], []
    for _ in range(n):
        a = np.full((156, 156), 60.0, np.float32)
        for tile, cell in zip(tiles, rng.permutation(9)):
            y, x = 52 * (cell // 3) + rng.integers(4, 26), 52 * (cell % 3) + rng.integers(4, 26)
            a[y : y + 22, x : x + 22] = tile
        out.append(a)
    return out


def test_copies_that_share_only_common_words(spark):
    """Copies of ids of the middle among images of equal words: no bucket leaves a pair out."""
    rows = []
    for k, g in enumerate(arranged(40, 4)):
        rows.append((10 * k, media.encode_png(g)))
        if 16 <= k < 26:
            rows.append((10 * k + 1, media.encode_png(np.rint(g * 0.8 + 25))))
    got = {r["image_id"]: r["component_id"] for r in media.find_copies(spark, spark.createDataFrame(rows, "image_id long, image binary").repartition(4)).collect()}
    met = [k for k in range(16, 26) if got[10 * k + 1] == got[10 * k]]
    assert len(met) == 10 and len(set(got.values())) > 25  # images with two tiles alike are linked too


def test_slices_and_large_buckets_change_nothing(spark, monkeypatch):
    """One or many slices, buckets met by members or by pairs of corners; no exchange holds much more than its room."""
    rows = []
    for k, g in enumerate(arranged(12, 4)):
        rows.append((10 * k, media.encode_png(g)))
        if 5 <= k < 8:
            rows.append((10 * k + 1, media.encode_png(np.rint(g * 0.8 + 25))))
    df = spark.createDataFrame(rows, "image_id long, image binary").repartition(4)
    whole = sorted(media.find_copies(spark, df, hot=4).collect())
    sent = []
    add = Scratch.add
    monkeypatch.setattr(Scratch, "add", lambda self, some, name, *by: (sent.append(name), add(self, some, name, *by)))
    monkeypatch.setattr(media, "LEAST_ROOM", 1 << 19)
    assert sorted(media.find_copies(spark, df, hot=4).collect()) == whole
    assert min(sent.count(name) for name in ("twos", "pairs-large")) > 1
    got = {r["image_id"]: r["component_id"] for r in whole}
    assert all(got[10 * k + 1] == got[10 * k] for k in range(5, 8))


def test_meetings_are_all_pairs():
    rng = np.random.default_rng(2)
    lens = rng.integers(1, 9, 40)
    first = rng.random(lens.sum()) < 0.5
    got = [(int(a), int(b)) for i, j in meetings.meet(lens, first) for a, b in zip(i, j)]
    at = np.repeat(np.arange(40), lens)
    assert sorted(got) == [(a, b) for a in range(len(at)) for b in range(a + 1, len(at)) if at[a] == at[b] and first[a]]


def test_repeated_and_null_image_ids(spark):
    a, b = drawings(2, 3)
    rows = [(1, a), (2, a), (2, b), (3, b), (None, a), (None, None), (4, None), (4, None)]
    df = spark.createDataFrame([(i, None if g is None else media.encode_png(g)) for i, g in rows], "image_id long, image binary")
    got = media.find_copies(spark, df).collect()
    assert Counter(r["image_id"] for r in got) == Counter(i for i, _ in rows)
    assert {r["component_id"] for r in got if r["image_id"] in (1, 2, 3)} == {1} and {r["component_id"] for r in got if r["image_id"] == 4} == {4}
    assert all(r["component_id"] is None and r["n_links"] == 0 for r in got if r["image_id"] is None)
    vectors = spark.createDataFrame([(1, [0.5] * 8), (1, [0.5] * 8), (None, [1.0] * 8), (2, None)], "vec_id long, embedding array<double>")
    assert Counter(r["image_id"] for r in media.media_column(vectors).collect()) == Counter([2, 3, 2, 3, None, None, 4, 5])


def test_copies_are_found_and_others_left_alone(spark):
    made = drawings(40)
    rows = []
    for k, g in enumerate(made):
        rows += [(10 * k, media.encode_png(g)), (10 * k + 1, media.encode_png(media.edited(g, k % 4))), (10 * k + 2, media.encode_png(g))]
    rows += [(1000, None), (1001, b"junk"), (1002, media.encode_png(np.full((40, 40), 9.0))), (1003, media.encode_png(np.ones((3, 3)))), (None, media.encode_png(made[0]))]
    df = spark.createDataFrame([(i, d, "x", 1) for i, d in rows], "image_id long, image binary, pixels string, u int")
    got = media.find_copies(spark, df).collect()
    assert Counter(r["image_id"] for r in got) == Counter(i for i, _ in rows)
    by = {r["image_id"]: r for r in got if r["image_id"] is not None}
    for k in range(40):
        assert {by[10 * k + j]["component_id"] for j in range(3)} == {10 * k}
        assert by[10 * k + 2]["class_id"] == 10 * k and by[10 * k]["n_links"] >= 1
    for i in (1000, 1001, 1002, 1003):
        assert by[i]["component_id"] == i and by[i]["n_links"] == 0
    assert media.find_copies(spark, df.limit(0)).count() == 0


def test_consensus_needs_one_transform():
    d = media.describe(np.stack(drawings(2)))
    n = [len(x[0]) for x in d]
    assert media.consensus(d[0], d[0]) > 20 and not media.agrees(media.consensus(d[0], d[1]), *n)
    shuffled = (np.random.default_rng(0).permutation(d[0][0]), *d[0][1:])
    assert media.consensus(d[0], shuffled) < media.consensus(d[0], d[0]) / 2


# --- 3: chats ------------------------------------------------------------------------------


def brute_chat(rows, block=256, most=1024):
    conv, out = {}, {}
    for c, t, s, x in rows:
        conv.setdefault(c, []).append((-1 if t is None else t, s or "unknown", (x or "").replace("<|", "< |")))
    for c, turns in conv.items():
        in_block, in_turn, seen, parts = Counter(t // block for t, _, _ in turns), Counter(t for t, _, _ in turns), Counter(), {}
        for r in sorted(turns):
            b, part = r[0] // block, 0
            if in_block[b] > most:
                ways = -(-in_turn[r[0]] // most)
                part = (r[0] - b * block) * (1 << 40) + zlib.crc32(f"{r[1]}\x01{r[2]}".encode()) % ways * (1 << 20) + seen[r] // most
            seen[r] += 1
            parts.setdefault((b, part), []).append(r)
        for me in {s for _, s, _ in turns if s != "system"}:
            for (b, part), own in parts.items():
                text, spans = "", []
                for _, s, x in sorted(own):
                    name = s.replace("<|", "< |").replace("|>", "| >").replace("\n", " ").replace("\r", " ")
                    text += "<|assistant|>\n" if s == me else "<|system|>\n" if s == "system" else f"<|user name={name}|>\n"
                    a = len(text)
                    text += x + chat.END
                    if s == me:
                        spans.append((a, len(text)))
                    text += "\n"
                out[c, me, b, part] = (len(own), text, ",".join(f"{a}:{e}" for a, e in spans), sum(e - a for a, e in spans))
    return out


def chat_rows(spark, rows, **more):
    df = spark.createDataFrame([(*r, "e", 1) for r in rows], "conv_id long, turn long, role string, text string, segment string, part int")
    got = chat.rotate_perspectives(df, **more).collect()
    found = {(r["conv_id"], r["perspective"], r["block"], r["part"]): (r["n_turns"], r["rendered"], r["mask"], r["n_masked"]) for r in got}
    assert len(found) == len(got)
    return found


def test_perspectives_equal_brute_force(spark):
    rng = random.Random(1)
    names = ["ann", "bob", "cy", "system", None, "x|>\n<|assistant|>"]
    rows = [(c, t if rng.random() < 0.9 else None, rng.choice(names), rng.choice(["hé🙂", "", None, "a <|end|> b", "x" * 500])) for c in [*range(12), None] for t in range(rng.randint(1, 9))]
    rows += [(50, 0, "system", "alone"), (60, 5, "ann", "same"), (60, 5, "ann", "same"), (60, 700, "bob", "far")]
    found = chat_rows(spark, rows)
    assert found == brute_chat(rows)
    assert not any("x|>" in v[1] for v in found.values())
    assert chat_rows(spark, []) == {}


def test_hot_turns_are_parted(spark):
    rows = [(None, None, "ann" if k % 3 else "bob", f"text {k}") for k in range(400)] + [(1, 7, "ann", "same")] * 150 + [(1, k, "bob", "x") for k in range(300)] + [(2, 0, "cy", "y")]
    found = chat_rows(spark, rows, part_rows=40)
    assert found == brute_chat(rows, most=40)
    assert max(v[0] for v in found.values()) < 80 and sum(v[0] for k, v in found.items() if k[1] == "ann") == 850


# --- 5: urls ----------------------------------------------------------------------------------


def brute_url(url):
    text = url or ""
    rest = text.split("://", 1)[1] if "://" in text else ""
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]
    best = None
    for what, rule in urlfilter.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = (what, rule)
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    inner = "abcdefghijklmnopqrstuvwxyz0123456789"

    def has(term):
        return any(low.startswith(term, k) and (k == 0 or low[k - 1] not in inner) and (k + len(term) == len(low) or low[k + len(term)] not in inner) for k in range(len(low)))

    found = {t: w for t, w in urlfilter.read_terms().items() if has(t)}
    soft = [w for w in found.values() if w is not None]
    bad = len(soft) < len(found) or (len(soft) >= 2 and sum(soft) >= 1.0 - 1e-9)
    return host, path, best and best[1], best[0] if best else "block" if bad else "allow"


def test_urls_equal_brute_force(spark):
    rng = random.Random(2)
    bits = ["http://", "https://", "WWW.", "example.net", "Example.COM", "a.org", "net", ".", "/", "/en/", "/de/", "/fr/", "?", "#", "casino", "free", "bets", "-", "freebets", "://", "x", "é", "adult", "\n", " ", "win", "cheap", "now", "sale", "best-"]
    urls = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 9))) for _ in range(1200)] + [None, "", "http://net/", "http://net", "http://x.net/a", "http://example.net/en/", "h://b.org/fr/x?y://z", "http://essex.example/", "HTTP://SEX.example/" + "y" * 9000]
    rows = [(k % 1100, u) for k, u in enumerate(urls)] + [(None, "http://a.b/")]
    df = spark.createDataFrame([(*r, "h", 1) for r in rows], "page_id long, url string, host string, n_soft int")
    got = urlfilter.filter_urls(df).collect()
    assert Counter((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got) == Counter((i, *brute_url(u)) for i, u in rows)
    assert urlfilter.filter_urls(df.limit(0)).count() == 0


def test_url_terms(tmp_path):
    terms = urlfilter.read_terms()
    assert len(terms) > 150 and terms["casino"] is None and terms["poker"] == 0.5 and terms["sale"] < 0.5
    a = urlfilter.automaton(terms)
    assert urlfilter.hits(a, "http://POKER.x/best-sale?sale&unsex") == {"poker", "best", "sale"}
    bad = tmp_path / "terms.tsv"
    bad.write_text("term\tclass\tweight\nUpper\tsoft\t1\n")
    with pytest.raises(ValueError):
        urlfilter.read_terms(str(bad))


# --- pipeline -------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Clean texts, junk, near copies and secrets, with labels for most."""
    folder = tmp_path_factory.mktemp("corpus")
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("aeioukmnrst") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    clean = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    rows, labels, copies = [], [], {}
    for k in range(500):
        words = clean(rng.randint(60, 150))
        if k % 5 == 0:
            text, good = " ".join(w.upper() + "!!" for w in words), 0
        elif k % 11 == 0 and k > 20:
            text, good = rows[k - 1][1], 1
            if rows[k - 1][1] is not None and (k - 1) % 5:
                copies[k] = k - 1
        else:
            text, good = " ".join(words), 1
            if k % 7 == 0:
                text += f" password=hunter{k}abcdef"
        rows.append((k, text, "en", "src0" if k % 3 else "src1", len(text)))
        labels.append((k, good if k % 11 else int(k % 5 > 0), 0))
    rows += [(600, None, "en", None, None), (601, "", None, "s", 0), (602, "too few words", "de", "s", 13), (None, " ".join(clean(90)), "en", "s", 9)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_pipeline_stages_equal_their_operators(spark, corpus):
    docs = table(spark, corpus, "documents")
    labels = table(spark, corpus, "labels")
    names, functions = zip(*corpus_pipeline.STAGES)
    assert len(names) == 5
    current = docs
    ids = lambda df: Counter(r["doc_id"] for r in df.select("doc_id").collect())
    expected = [
        lambda d: Counter(r["doc_id"] for r in nbsvm.quality_scores(spark, d, labels).collect() if r["predicted"]),
        lambda d: Counter(r["doc_id"] for r in quality_rules.apply_rules(spark, d, labels).collect() if r["kept"]),
        lambda d: Counter(r["doc_id"] for r in minhash.near_duplicates(spark, d).collect() if r["kept"]),
        ids,
    ]
    for k, (f, want) in enumerate(zip(functions[:4], expected)):
        after = f(spark, current, corpus)
        assert after.columns == docs.columns
        assert ids(after) == want(current)
        came = [(r["doc_id"], r["text"]) for r in current.collect()]
        if k == 1:  # what fails the base by plain counting is gone
            gone = [i for i, t in came for c in [brute_features(t)] if c[0] < 50 or 100 * c[4] > 50 * c[0]]
            assert not set(gone) & set(ids(after))
        if k == 2:  # one document a component, by all pairs
            component, _ = brute_components(came)
            assert ids(after) == Counter([i for i, c in component.items() if i == c] + [i for i, _ in came if i is None])
        if k == 3:  # no base pattern is left, nothing else changed
            texts = {r["doc_id"]: r["text"] for r in after.collect()}
            assert not any(brute_base(t) for t in texts.values() if t)
            assert all(texts[i] == t for i, t in came if not secret_scan.scan(t or "", secret_scan._pattern(secret_scan.ALLOW)))
        current = after
    kept = ids(current)
    assert not any(k % 5 == 0 for k in kept if k is not None) and 602 not in kept and None in kept
    clean = [k for k in range(500) if k % 5 and k % 11]
    assert sum(k in kept for k in clean) / len(clean) > 0.97
    allow = secret_scan._pattern(secret_scan.ALLOW)
    for r in current.collect():
        assert not [s for s in secret_scan.scan(r["text"] or "", allow) if s[1] < 3] and (r["n_chars"] == len(r["text"]))
    got = corpus_pipeline.run(spark, corpus)
    assert Counter({i: 1 for i in kept}) == Counter({r["doc_id"]: 1 for r in got.filter("piece = 0").collect()})


def test_pipeline_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
