"""Encoding and decoding, media, url filter."""

import hashlib
import re
import zlib

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from rulesift.llm import media, pieces, url_filter
from rulesift.llm.queries import ORACLE_SQL, URL_RULES

MODEL = pieces.model_bytes()
VOCABULARY = pieces.Vocabulary(MODEL)
LIBRARY = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
TEXTS = ["", " ", "hello world", "  two  blanks  ", "line\nbreaks\n\n and\ttabs\r\n", "naïve café, 日本語 and 😀!", "x" * 3000, "ab " * 400, "\u00a0", "ÿÿ"]


def agenda_ids(e, text, variant):
    """Brute force: the best pair of each part, leftmost on ties, is looked for anew after every step."""
    v, key, number, ids = e.v, e.text_key(text.encode(), variant), 0, []
    side = {x[i : i + 2] for x in v.ids for i in range(len(x) - 1)} if not hasattr(v, "side") else v.side
    v.side = side
    for chunk in re.findall(r"\n|[ ]*[^ \n]+|[ ]+", " " + text) if text else []:
        marks = ["\0" if c == pieces.META else pieces.META if c == " " else c for c in chunk]
        cuts = [0, *(i for i in range(1, len(marks)) if marks[i - 1] + marks[i] not in side), len(marks)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            own = int(e.part_keys(np.array([key], np.uint64), np.array([number]))[0])
            number += 1
            symbols, places, struck = marks[a:b], list(range(b - a)), set()
            while True:
                open_ = [(v.ranks[x + y], i) for i, (x, y) in enumerate(zip(symbols, symbols[1:], strict=False)) if x + y in v.ranks and (places[i], x, y) not in struck]
                if not open_:
                    break
                rank, i = min(open_)
                if e.skipped(own, places[i], rank):
                    struck.add((places[i], symbols[i], symbols[i + 1]))
                else:
                    symbols[i : i + 2], places[i + 1 : i + 2] = [symbols[i] + symbols[i + 1]], []
            for x in symbols:
                ids += [v.ids[x]] if x in v.ids else [int(v.byte_ids[k]) for k in (pieces.META if x == "\0" else x).encode("utf-8", "surrogateescape")]
    return ids


@pytest.mark.parametrize("text", TEXTS)
def test_without_dropout_ids_are_the_librarys(text):
    e = pieces.Encoder(VOCABULARY, 0.0)
    assert e.encode(text.encode()).tolist() == LIBRARY.encode(text)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab e\n\t▁é日😀.,"), max_size=60), st.integers(0, 3), st.floats(0, 1))
def test_every_segmentation_decodes(text, seed, dropout):
    e = pieces.Encoder(VOCABULARY, dropout, seed)
    assert pieces.decode(e.encode(text.encode(), seed), VOCABULARY) == text.encode()
    assert e.encode(text.encode(), seed).tolist() == agenda_ids(e, text, seed)


def test_dropout_is_seeded_and_varied():
    text = b"something interesting happens to everybody eventually"
    ids = lambda seed, variant=0, share=0.3: tuple(pieces.Encoder(VOCABULARY, share, seed).encode(text, variant).tolist())
    assert ids(1) == ids(1) and len({ids(s) for s in range(20)}) > 10 and ids(1, 0) != ids(1, 1)
    assert len(ids(1, share=1.0)) == len(text) + 1  # no merge is left
    assert pieces.decode(pieces.Encoder(VOCABULARY).encode(b"\xff\xfe a\x80"), VOCABULARY) == b"\xff\xfe a\x80"


def test_every_occurrence_draws_for_itself():
    e = pieces.Encoder(VOCABULARY)
    word = b"interesting "
    ids = e.encode(word * 400).tolist()
    cuts, at = set(), 0
    for _ in range(400):
        size, end = 0, at
        while size < len(word):
            size += len(VOCABULARY.raw[ids[end]])
            end += 1
        cuts.add(tuple(ids[at:end]))
        at = end
    assert len(cuts) > 5
    others = {tuple(e.encode(b"interesting things happen %d" % i).tolist()[:-6]) for i in range(60)}
    assert len(others) > 10  # nor are texts cut alike


@pytest.mark.parametrize("short", [pieces.SHORT, 5, 1])
@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.6, 1.0])
def test_encoding_is_the_agendas_draws(monkeypatch, short, dropout):
    monkeypatch.setattr(pieces, "SHORT", short)  # longer parts have a heap each
    e = pieces.Encoder(VOCABULARY, dropout, 3)
    texts = [*TEXTS, "interesting meta ▁ symbols everywhere " * 20, "Донаудампф größte ▁▁ x" * 9]
    want = [agenda_ids(e, t, 1) for t in texts]
    assert [e.encode(t.encode(), 1).tolist() for t in texts] == want
    assert [x.tolist() for x in e.encode_all([t.encode() for t in texts], [1] * len(texts))] == want
    monkeypatch.setattr(pieces, "AT_ONCE", 40)  # long texts come in slices
    assert [x.tolist() for x in e.encode_all([t.encode() for t in texts], [1] * len(texts))] == want
    assert [pieces.decode(np.array(x, np.int64), VOCABULARY).decode() for x in want] == texts


def test_encode_table(spark):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(None, "null id", "c"), (99, None, "c"), (0, "repeated id", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = pieces.encode_texts(df)
    out = got.collect()
    assert len(out) == len(rows) and all(r["lossless"] and r["n_tokens"] == len(r["ids"]) for r in out)
    assert {(r["doc_id"], r["decoded_sha256"]) for r in out} == {(i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in rows}
    assert sorted(r["text"] for r in pieces.decode_ids(got.select("doc_id", "ids")).collect()) == sorted(t or "" for _, t, _ in rows)
    assert pieces.tokenize(df.limit(0)).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.binary(max_size=900))
def test_media_is_lossless(data):
    payload = media.payload_of(data)
    micros, frames = media.read_avi(media.write_avi(media.encode_frames(payload)))
    assert frames.tobytes() == payload and len(payload) % 192 == 0 and payload[: len(data)] == data and micros == 40_000


def test_general_decoder_reads_own_frames():
    payload = bytes(range(192))
    assert media.decode_jpeg(media.encode_frames(payload)[0]).tobytes() == payload


def _baseline(block: np.ndarray) -> bytes:
    """A baseline image of one 8 x 8 block with quantiser 1 and fixed-width tables: DC categories and all AC symbols by eight bits."""
    dct = media._DCT @ (block.astype(float) - 128) @ media._DCT.T
    q = np.rint(dct).astype(int).reshape(-1)
    order = media._zigzag()
    dc = bytes([0] * 7 + [12] + [0] * 8) + bytes(range(12))
    symbols = [0x00, 0xF0] + [r << 4 | s for r in range(15) for s in range(1, 11)]
    ac = bytes([0] * 7 + [len(symbols)] + [0] * 8) + bytes(symbols)
    bits = ""

    def value(v):
        s = abs(v).bit_length()
        return s, format(v if v > 0 else v + (1 << s) - 1, f"0{s}b") if s else ""

    s, extra = value(int(q[0]))
    bits += format(s, "08b") + extra
    run = 0
    for k in range(1, 64):
        v = int(q[order[k]])
        if not v:
            run += 1
            continue
        while run > 14:
            if run >= 16:
                bits += format(symbols.index(0xF0), "08b")
                run -= 16
            else:
                return b""  # run of 15: not in this small table
        s, extra = value(v)
        bits += format(symbols.index(run << 4 | s), "08b") + extra
        run = 0
    bits += format(0, "08b")
    bits += "1" * (-len(bits) % 8)
    scan = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
    seg = media._segment
    return b"\xff\xd8" + seg(0xDB, b"\x00" + b"\x01" * 64) + seg(0xC0, b"\x08\x00\x08\x00\x08\x01\x01\x11\x00") + seg(0xC4, b"\x00" + dc) + seg(0xC4, b"\x10" + ac) + seg(0xDA, b"\x01\x01\x00\x00\x3f\x00") + scan + b"\xff\xd9"


def test_baseline_frames_and_shots():
    rng = np.random.default_rng(4)
    blocks = [np.clip(np.add.outer(np.arange(8) * 3, np.arange(8) * 2) + base + rng.integers(0, 3), 0, 255) for base in [40] * 12 + [200] * 12]
    frames = [f for f in map(_baseline, blocks) if f]
    assert len(frames) > 20
    micros, got = media.read_avi(media.write_avi(frames, 8, 8))
    assert max(np.abs(g.astype(int) - b).max() for g, b in zip(got, blocks, strict=False)) <= 1
    clips = media.shots(got, micros)
    assert [c["frames"] for c in clips] == [12, len(frames) - 12] and clips[1]["start_ms"] == 480 == clips[0]["end_ms"]
    assert media.cuts(np.tile(np.eye(16)[0], (30, 1))).tolist() == [0] and media.shots(got[:0], micros) == []


@pytest.mark.parametrize("spoil", [lambda b: b"x" + b[1:], lambda b: b[:200], lambda b: b[:-4] + b"\xff\xff\xff\x7f"])
def test_damaged_files_are_errors(spoil):
    with pytest.raises(ValueError):
        media.read_avi(spoil(media.write_avi(media.encode_frames(media.payload_of(b"abc" * 300)))))


def test_media_table(spark):
    rows = [(1, "abc", "m"), (2, None, "m"), (3, "", "m"), (4, "é" * 50_000, "m"), (1, "abc", "m"), (None, "abc", "m")]
    df = spark.createDataFrame(rows, "doc_id long, text string, media string")
    got = media.store_and_read(df).collect()
    assert len(got) == len(rows)
    for r in got:
        text = {1: "abc", 2: "", 3: "", 4: "é" * 50_000, None: "abc"}[r["doc_id"]].encode()
        payload = media.payload_of(text)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    assert len({(r["media_sha256"], r["feature"]) for r in got if r["doc_id"] in (1, None)}) == 1
    files = media.encode(df)
    assert media.clips(files.select("doc_id", "media")).where("doc_id = 4").groupBy().sum("frames").first()[0] == -(-100_000 // 192)
    assert media.store_and_read(df.limit(0)).count() == 0


URLS = [
    "http://a.b.example.org/en/12?x", "HTTPS://Example.ORG/es/", "http://example.org", "http://example.org/en", "http://notexample.org/es/x", "http://x.com/fr/#a", "http://com/de/", "x.com/de/", None, "", "://", "http://org?x=/es/", "a://b.com/fr/://c.org/", "http://ÉX.com/DE/", "http://x.com/de/\n/fr/",
    "http://example.org./es/", "http://a..org/",
]


def plain(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
        host, tail = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = tail[: min([i for i in map(tail.find, "?#") if i >= 0], default=len(tail))]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


def test_url_rules_and_sql(spark):
    import duckdb

    rows = list(enumerate(URLS)) + [(0, URLS[0])]
    df = spark.createDataFrame([(i, u, "x") for i, u in rows], "page_id long, url string, rule string")
    got = sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(df, URL_RULES).collect())
    assert got == sorted((i, *plain(u, URL_RULES)) for i, u in rows)
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", rows)
    assert sorted(con.execute(ORACLE_SQL["op4_url_filter"]).fetchall()) == got
    assert url_filter.judge(df.limit(0), URL_RULES).count() == 0 and all(r["rule"] is None for r in url_filter.judge(df, []).collect())


def test_cascade_is_exact_over_its_universe(spark):
    keys = [f"k{i}" for i in range(4000)]
    listed = keys[::7]
    universe = spark.createDataFrame([(k,) for k in keys], "key string")
    small = url_filter._shape
    cascade = url_filter.build(universe, spark.createDataFrame([(k,) for k in listed], "key string"), len(listed))
    assert small(10, 0.5)[0] % 64 == 0 and len(cascade.levels) > 1
    got = {r["key"] for r in universe.where(cascade.listed(universe["key"])).collect()}
    assert got == set(listed)


def test_long_rule_lists(spark):
    rules = [(f"h{i}.example{i % 50}.org", f"/p{i % 7}/", "block" if i % 3 else "allow") for i in range(30_000)]
    urls = [(i, f"http://{'www.' * (i % 3)}h{i * 37 % 45_000}.example{i * 37 % 45_000 % 50}.org/p{i % 8}/x") for i in range(600)]
    got = sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(spark.createDataFrame(urls, "page_id long, url string"), rules).collect())
    by_host = {h: [(h, p, v)] for h, p, v in rules}
    near = lambda u: [r for h in [".".join(u.split("/")[2].split(".")[k:]) for k in range(4)] for r in by_host.get(h, [])]
    assert got == sorted((i, *plain(u, near(u))) for i, u in urls) and 20 < sum(r[3] is not None for r in got) < 300


def test_url_filter_runs_no_python(spark):
    df = spark.range(3).selectExpr("id AS page_id", "concat('http://x.org/', id) AS url")
    plan = url_filter.judge(df, URL_RULES)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Join" not in plan
