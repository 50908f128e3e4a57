"""Round trips and brute force without Spark: JPEG, FM-index, sketches, extraction."""

import hashlib
import random
import time
import zlib

import numpy as np

from millrace.llm import decontam, html_extract, media, near_dedup, quality, substring_dedup


def test_jpeg_round_trip():
    r = random.Random(1)
    texts = [None, "", "a", "é" * 500, "".join(chr(r.choice([32, 65, 255, 0x4E00, 0x1F600])) for _ in range(3000)), "x" * (192 * 9000)]
    _, images = media.stored(texts)
    for t, row in zip(texts, media.read_back(images), strict=True):
        payload, _ = media.payload_of(t)
        assert row[:2] == (len(payload), hashlib.sha256(payload).hexdigest())
    rows = next(media.round_trip(False)(iter([__import__("pandas").Series(texts * 3)])))
    assert len(rows) == 18 and list(rows.n_bytes[:3]) == [0, 0, 1]


def test_jpeg_parts():
    _, (image,) = media.stored(["hello " * 100])
    (w, h, pixel), = media.decode([image])[0]
    assert (w, h) == (1536, 32) and pixel.shape == (4, 192)
    assert image[:2] == b"\xff\xd8" and image[-2:] == b"\xff\xd9"


def test_fm_index_counts_and_places():
    rng = np.random.default_rng(5)
    text = rng.integers(1, 4, 400)
    index = decontam.FmIndex(text, 4)
    for m in (1, 3, 6):
        patterns = np.array([text[i : i + m] for i in range(0, 60, 7)] + [[1] * m])
        lo, hi = index.search(patterns)
        for p, a, b in zip(patterns, lo, hi, strict=True):
            want = [i for i in range(len(text) - m + 1) if (text[i : i + m] == p).all()]
            assert sorted(index.locate(np.arange(a, b))) == want


def test_leaks_without_hits_and_short_items():
    items = [("1", "alpha beta gamma"), ("2", None), ("3", " ".join(f"w{i}" for i in range(12))), ("4", "")]
    phrases = decontam.Phrases(items, 10)
    texts = ["w1 w2 w3 w4 w5 w6 w7 w8 w9 w9 w9 w1", None, "", "x Alpha, beta-GAMMA y", " ".join(f"W{i}" for i in range(11)) + " z"]
    out = decontam.leaks(texts, phrases)
    assert [list(x) for x in out["items"]] == [[], [], [], ["1"], ["3"]]
    assert [(list(s), list(e)) for s, e in zip(out.starts, out.ends, strict=True)][3:] == [([1], [4]), ([0], [11])]
    assert list(decontam.leaks(texts, decontam.Phrases([], 10)).n_words) == [12, 0, 0, 5, 12]
    assert decontam.cut_spans("x Alpha, beta-GAMMA y", [1], [4]) == "x  y"


def test_sketch_agreement_follows_jaccard():
    rng = np.random.default_rng(2)
    for n, shared in ((3, 3), (40, 30), (900, 700)):
        base = np.unique(rng.integers(0, 2**63, n + 50, dtype=np.uint64))
        a, b = base[:n], np.concatenate((base[:shared], base[n : n + 40]))
        j = shared / (n + 40)
        share = np.mean(near_dedup.sketch(np.sort(a)) == near_dedup.sketch(np.sort(b)))
        assert abs(share - j) < 0.13


def test_extraction_on_unseen_layouts():
    field, right, total = html_extract.default_field(), 0, 0
    for blocks, labels in html_extract.labelled_blocks(60, seed=1234):
        found = field.viterbi(html_extract.features(blocks))
        right += sum(int(a) == b for a, b in zip(found, labels, strict=True))
        total += len(labels)
    assert right / total > 0.97
    assert html_extract.main_text(None, field) == html_extract.main_text("<p> &nbsp; </p>", field) == ""


def test_quality_learns_and_bears_empty_texts():
    r = random.Random(3)
    good = [" ".join(r.choice("the of and tree house river".split()) for _ in range(60)) for _ in range(60)]
    bad = [" ".join(r.choice("BUY!! NOW!! %%% $$$".split()) for _ in range(60)) for _ in range(60)]
    model = quality.train(good[:40] + bad[:40], [1] * 40 + [0] * 40)
    assert min(model.scores(good[40:])) > max(model.scores(bad[40:]))
    assert len(model.scores(["", None, "x"])) == 3
    assert list(quality.train([], []).scores(["a"])) == [0.5]


def tiny_jpeg(width, height, seed):
    """A baseline 4:2:0 JPEG with AC runs and a 16-bit quantiser, and the DC values of its luminance blocks, built bit by bit."""
    r, bits = random.Random(seed), []
    put = lambda value, n: bits.extend(value >> k & 1 for k in range(n - 1, -1, -1))
    ac = [0x00, 0x01, 0xF0, 0x22, 0x53]  # three bits each, in order; sizes of DC values in four bits each
    columns, rows = -(-width // 16), -(-height // 16)
    luma = np.zeros((2 * rows, 2 * columns), int)
    pred = [0, 0, 0]
    for y in range(rows):
        for x in range(columns):
            for block, c in enumerate((0, 0, 0, 0, 1, 2)):
                d = r.randint(-60, 60)
                pred[c] += d
                n = abs(d).bit_length()
                put(n, 4)
                put(d if d > 0 else d + (1 << n) - 1, n)
                k = 1
                while k < 64 and r.random() < 0.7:
                    s = r.choice(ac[1:])
                    run = s >> 4
                    if k + run > 63:
                        break
                    put(ac.index(s), 3)
                    put(r.getrandbits(s & 15) if s & 15 else 0, s & 15)
                    k += run + 1
                if k < 64:
                    put(0, 3)
                if c == 0:
                    luma[2 * y + block // 2, 2 * x + block % 2] = pred[0]
    bits += [1] * (-len(bits) % 8)
    scan = bytes(int("".join(map(str, bits[i : i + 8])), 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0")
    segment = lambda m, body: bytes((255, m)) + (len(body) + 2).to_bytes(2, "big") + body
    dc = bytes([0, 0, 0, 12] + [0] * 12) + bytes(range(12))
    table = bytes([0, 0, 5] + [0] * 13) + bytes(ac)
    quant = b"\x10" + (5).to_bytes(2, "big") * 64
    frame = bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    data = b"\xff\xd8" + segment(0xFE, b"note") + segment(0xDB, quant) + segment(0xC4, b"\0" + dc + b"\x10" + table) + segment(0xC0, frame) + segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + scan + b"\xff\xd9"
    return data, np.clip((luma * 5 + 4) // 8 + 128, 0, 255)[: -(-height // 8), : -(-width // 8)]


def test_jpeg_with_ac_runs_and_subsampling():
    for k, (w, h) in enumerate(((40, 24), (16, 16), (1, 1), (200, 90))):
        data, want = tiny_jpeg(w, h, k)
        ((width, height, pixel),) = media.decode([data])[0]
        assert (width, height) == (w, h) and pixel.shape == want.shape and (pixel == want).all()


P = "The river rose again in the night, and by morning the lower road was under water for half a mile."
Q = "Nobody was hurt, but the council has asked people to stay away from the bridge until it has been looked at."
PAGES = {
    f'<html><head><title>River</title></head><body><nav><a href=/>Home</a></nav><h1>River rises</h1><p>{P}</p><svg class="i"/><p>{Q}</p><footer>© 2020</footer></body></html>': f"River rises {P} {Q}",
    f"<html><head><title>River</title></head><body><h1>River rises</h1><p title=it's>{P}</p><p>{Q}</p><p>It's over.</p><footer>© 2020</footer></body></html>": f"River rises {P} {Q} It's over.",
    f"<p title=it's>{P}</p><p>{Q}</p>": f"{P} {Q}",
    f'<body><div class="page"><div class="story"><p>{P}</p></div><!-- c --></body>': P,
    "<article><p>One short paragraph.</p></article>": "One short paragraph.",
    f"<p>{P}": P,
    P: P,
    f"<template><p>{P}</p><p>{Q}</p>": f"{P} {Q}",
    f"<svg><path d=1><p>{P}</p>": P,
    f'<html><head><title>River | Daily</title><script>var a="<p>x</p>"</script></head><body><header class="site"><a href=/>Daily</a></header><nav><ul><li><a href=/a>News</a><li><a href=/b>Sport</a></ul></nav><div class="cookie-banner"><p>We use cookies to make this site work better for you.</p><button>OK</button></div><main><h1>River rises</h1><p>{P}</p><div class="ad">Buy boots now</div><p>{Q}</p><ul><li>Lower road closed to traffic</li><li>Bridge to be inspected &amp; painted</li></ul></main><aside class="related"><h3>More</h3><ul><li><a href=/c>Rain to last until the weekend</a></ul></aside><section class="comments"><h3>Comments</h3><div class="comment"><p>I saw it rise, it was quick and it took my shed.</p></div></section><form><label>Name</label><input><button>Send</button></form><footer><p>© 2020 Daily · Imprint</p></footer></body></html>': f"River rises {P} {Q} Lower road closed to traffic Bridge to be inspected & painted",
}


def test_extraction_on_pages_by_hand():
    field = html_extract.default_field()
    for page, want in PAGES.items():
        assert html_extract.main_text(page, field) == want, page[:80]


def test_hostile_pages_take_linear_time():
    field = html_extract.default_field()
    start = time.time()
    for page in ("<a " * 350_000, "<div>x" * 170_000, "<b>" * 100_000 + "</i>" * 100_000, "<p>" + "<b>" * 300_000 + "<hr>" * 50_000, "<a x='" * 150_000, "<" * 1_000_000, "<!x" * 300_000, "<template>" * 100_000, "<!--" * 250_000, "<svg>" * 200_000, "<a " + "b=c " * 250_000 + ">", "<a b='" + "c" * 1_000_000):
        html_extract.main_text(page, field)
    assert time.time() - start < 30


def test_scores_on_held_out_labels():
    """Real labels: the fold that training never sees."""
    import duckdb

    at = "/root/testdata/sf0.1"
    rows = duckdb.sql(f"SELECT doc_id, text, quality FROM '{at}/documents.parquet' JOIN '{at}/labels.parquet' USING (doc_id) ORDER BY doc_id").fetchall()
    held = [zlib.crc32(str(i).encode()) % 5 == 0 for i, _, _ in rows]
    own = [(t, y) for (_, t, y), h in zip(rows, held, strict=True) if not h]
    model = quality.train([t for t, _ in own], [y for _, y in own])
    test = [(t, y) for (_, t, y), h in zip(rows, held, strict=True) if h]
    score = model.scores([t for t, _ in test])
    right = np.mean([(s >= 0.3) == (y == 1) for s, (_, y) in zip(score, test, strict=True)])
    good, bad = ([s for s, (_, y) in zip(score, test, strict=True) if y == k] for k in (1, 0))
    auc = np.mean([[g > b for b in bad] for g in good])
    print(f"held out: {len(test)} rows, accuracy {right:.4f}, AUC {auc:.4f}")
    assert len(test) > 100 and right > 0.95 and auc > 0.98


def test_unique_windows_are_seldom_passed_on(monkeypatch):
    """Texts without a repeat, in a sketch of many small pieces: the share of runs that is told to be repeated stays under (1 - exp(-1/8))**2 and a margin."""
    import pandas as pd

    monkeypatch.setattr(substring_dedup, "PIECE", 1 << 12)
    r = random.Random(4)
    texts = [" ".join(str(r.getrandbits(30)) for _ in range(400)) for _ in range(400)]
    batch = pd.DataFrame({"id": range(400), "sign": range(400), "text": texts})
    for more in (1, 4):
        part = batch[: 100 * more]
        runs = sum(len(np.unique(substring_dedup.Windows([t.encode()], 50).route())) for t in part["text"])
        width = 1 << (substring_dedup.CELLS_PER_RUN * runs - 1).bit_length()
        pieces = pd.concat(substring_dedup.sketch_pieces(50, width)(iter([part[k : k + 50] for k in range(0, 100 * more, 50)])))
        assert pieces["piece"].nunique() > 3
        told: dict = {}
        for x in substring_dedup.merged_pieces(width)(iter([pieces.sort_values("piece")])):
            for row in x.itertuples():
                told.setdefault(row.id, []).append(row.cells)
        windows = passed = 0
        for i, t in enumerate(part["text"]):
            w = substring_dedup.Windows([t.encode()], 50)
            windows += len(w.at)
            passed += len(substring_dedup.estimated(w, [told.get(i, [])], width))
        assert passed < 0.025 * windows
