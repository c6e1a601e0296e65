import collections
import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest
from comparing import duck_rows, rows_of

P = pytest.importorskip("public_tokenizers")
registry = pytest.importorskip("tokenloom.llm.registry")
from tokenloom.llm import bpe, fingerprint, hostrules, htmltext, linededup, lshforest, packing, sharding, tokens, warc, wavelet  # noqa: E402

WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall
PASSAGE = " ".join(f"w{i}" for i in range(60))
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_tokens string, shard string, _k int"
ODD = [None, "", " ", "a", "\n\n", "x" * 30000, "  a  b ", "naïve x 　 y", "\x01 q \x01", "🙂🙂 a🙂", "<|endoftext|> it's 12 'S\r\n b", "same words here " * 9, "same words here " * 9]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, a repeated row, a null id, and columns whose names clash."""
    rows = [(i, t, "en", f"s{i % 2}" if i % 5 else None, 0, "x", "y", 1) for i, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[3], (None, "null id text " * 20, None, None, None, None, None, None)], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, sf_dir, name):
    assert rows_of(registry.queries()[name](spark, sf_dir)) == duck_rows(registry.oracle_sql()[name], sf_dir)


REPORTS = {
    "op2": lambda d: bpe.round_trip_report(d, P.path("byte_bpe_50k.tiktoken"), P.PATTERN),
    "op3": lambda d: packing.packed_documents(d, P.path("word_bpe_49k.json")),
    "op4": sharding.balanced_shards, "op5": linededup.drop_repeated_lines, "op7": fingerprint.fingerprint_report,
    "op8": lambda d: wavelet.shard_report(d, P.path("byte_bpe_50k.json"), 2), "op9": lshforest.class_report, "op10": hostrules.quality_report,
}


@pytest.mark.parametrize("op", sorted(REPORTS))
def test_odd_rows_and_empty_tables(odd, empty, op):
    assert REPORTS[op](empty).count() == 0
    pieces = 1 if op == "op3" else 0
    assert REPORTS[op](odd).count() >= odd.count() if pieces else REPORTS[op](odd).count() == odd.count()


def test_warc_odd_pages(spark):
    big = "p" * 500
    pages = spark.createDataFrame([(1, "http://a/b?c", big), (2, None, big), (3, "x y\nz", None), (4, "u", ""), (5, "http://[bad", big), (None, "u", "tiny")], "page_id bigint, url string, html string")
    got = {r["page_id"]: r for r in warc.capture_report(pages).collect()}
    assert [got[i]["record_type"] for i in (1, 2, 3, 4, 5, None)] == ["response", "revisit", "response", "response", "revisit", "response"]
    assert got[5]["refers_to"] == 1 and got[5]["payload_bytes"] == 500 and got[3]["payload_digest"] == hashlib.sha256(b"").hexdigest()
    assert warc.capture_report(pages.limit(0)).count() == 0
    made = warc.assemble(warc.read_records(warc.write_archives(pages))).collect()
    assert all(r["request"] and r["metadata"] and r["response"] for r in made) and len(made) == 6


def test_warc_repeated_rows_and_clashing_columns(spark):
    big = "q" * 200
    pages = spark.createDataFrame([(1, "u", big, 7, "x"), (1, "u", big, 8, "y"), (1, "v", "small", 9, "z"), (1, "v", "small", 9, "z"), (0, "u", big + "é", 1, "w"), (5, "u", big, 1, "w"), (None, "n", None, 0, "")], "page_id bigint, url string, html string, row int, digest string").coalesce(2)
    got = sorted((r["page_id"] if r["page_id"] is not None else -1, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.capture_report(pages).collect())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(-1, 0, sha(""), "response", None), (0, 202, sha(big + "é"), "response", None), (1, 5, sha("small"), "response", None), (1, 5, sha("small"), "response", None), (1, 200, sha(big), "response", None), (1, 200, sha(big), "revisit", 1), (5, 200, sha(big), "revisit", 1)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_warc_transactions_join_whoever_names_whom(spark):
    cols = "record_id string, type string, concurrent_to array<string>, refers_to string, uri string, date string, digest string, http_head string, fields string, n_bytes long, payload_sha256 string, payload binary"
    row = lambda i, kind, *named: (i, kind, list(named), None, f"uri {i}", None, None, f"head {i}", f"fields {i}", 1, None, None)
    def nested(*rows):
        found = warc.assemble(spark.createDataFrame(list(rows), cols)).collect()
        return sorted(([r[p]["record_id"] if r[p] else None for p in ("response", "request", "metadata")], [o["record_id"] for o in r["others"]]) for r in found)

    star = [row("r1", "response"), row("q1", "request", "r1"), row("m1", "metadata", "r1"), row("r2", "revisit"), row("w", "warcinfo")]
    assert nested(*star) == sorted([(["r1", "q1", "m1"], []), (["r2", None, None], [])], key=lambda x: (x[0][0], x))
    # a response that names its request, a chain, repeated headers, two requests, and one that names nobody known
    odd = [row("r1", "response", "q1"), row("q1", "request"), row("m1", "metadata", "q1"), row("r2", "response"), row("q2", "request", "r2"), row("m2", "metadata", "q2"), row("r3", "response"), row("q3", "request", "r3", "m3"), row("q4", "request", "r3"), row("m3", "metadata"), row("q9", "request", "gone"), row("c3", "conversion", "r3")]
    found = nested(*[x for x in odd if x[0] != "q9"])
    assert found == [(["r1", "q1", "m1"], []), (["r2", "q2", "m2"], []), (["r3", "q3", "m3"], ["q4", "c3"])]
    both = warc.assemble(spark.createDataFrame([*odd, odd[0]], cols)).collect()
    assert len(both) == 4 and {r["request"]["http_head"] for r in both if r["request"]["record_id"] == "q9"} == {"head q9"}
    assert warc.assemble(spark.createDataFrame([], cols)).count() == 0


def test_warc_reads_repeated_headers():
    import io

    data = warc.record([("WARC-Type", "request"), ("WARC-Record-ID", "<q>"), ("WARC-Concurrent-To", "<a>"), ("WARC-Concurrent-To", "<b>")], b"GET / HTTP/1.1\r\n\r\n")
    assert [h["warc-concurrent-to"] for h, _ in warc.records(io.BytesIO(data + data))] == [["<a>", "<b>"]] * 2


def test_prefix_bpe_is_tiktoken(docs):
    import tiktoken

    ranks = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ours = bpe.Codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    for text in [*docs.values(), *filter(None, ODD), "ab" * 3000, "a" * 3000]:
        ids = ours.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == theirs.encode_ordinary(text)
        assert ours.decode(ids) == text.encode()
    rng = np.random.default_rng(0)
    for _ in range(50):
        text = bytes(rng.choice(list(b"the anding ofre"), 400).tolist())
        table, at = bpe.PrefixTable(ours.bpe, text), int(rng.integers(0, 300))
        table.replace(at, at + 3, b"ing")
        assert table.last == bpe.PrefixTable(ours.bpe, text[:at] + b"ing" + text[at + 3 :]).last


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_piecewise_encoding_is_the_library_s(docs, name):
    from tokenizers import Tokenizer

    theirs = Tokenizer.from_file(P.path(name))
    texts = [*docs.values(), *filter(None, ODD), "a \n b", "\x1c \x1d a \x85 b", " \x01", "see bİ. now", "a क़. b", " <|endoftext|> x<|startoftext|>.y <|ENDOFTEXT|>, z"]
    rng = np.random.default_rng(11)
    alphabet = list("abTs'.,;<|> \n\t") + ["İ", "क़", "ß", "é", "e\u0301", "\u0307", "ﬁ", "🙂", "中", "ª", "<|endoftext|>", "<|startoftext|>", ". ", ", "]
    texts += ["".join(rng.choice(alphabet, n)) for n in rng.integers(1, 14, 5000)]
    texts += [f"see b{chr(c)}. now x{chr(c)}, y" for c in range(33, 0x2FFF)]
    for text, ids in zip(texts, tokens.TextEncoder(P.path(name)).encode_all(texts), strict=True):
        assert np.frombuffer(ids, "<u2").tolist() == theirs.encode(text, add_special_tokens=False).ids


def column_ids(encoder, texts):
    import pyarrow as pa

    out = []
    for counts, ids in encoder.encode_column(pa.array(texts, pa.string())):
        out += [own.tolist() for own in np.split(ids, np.cumsum(counts))[:-1]]
    return out


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_column_encoding_is_the_library_s(docs, name, monkeypatch):
    from tokenizers import Tokenizer

    theirs, rng = Tokenizer.from_file(P.path(name)), np.random.default_rng(12)
    texts = [*ODD, *list(docs.values())[::7], "  ", "J\u030cx J\u030c. ǰ", "l'ÉTÉ l'été, d'É!! É'S É's. x'.", "ΟΔΟΣ. ΟΔΟΣ", "\x01 a\x01b é\x01.", "<|endoftext|>", "中文。 中文.", "a<| b", "\t\u3000"]
    alphabet = list("abTsÉé'.,;!*<|> \n\n") + ["İ", "µ", "ß", "e\u0301", "\u0307", "\u0338", "K", "中", "²", "\x01", " ab", "\t"]
    texts += ["".join(rng.choice(alphabet, n)) for n in rng.integers(0, 20, 5000)]
    want = [theirs.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert column_ids(tokens.TextEncoder(P.path(name)), texts) == want
    monkeypatch.setattr(tokens, "GROUPED_BYTES", 1000)  # many runs, and pieces forgotten between them
    assert column_ids(tokens.TextEncoder(P.path(name), 50), texts) == want


def test_a_word_reaches_the_library_once_whatever_its_case_and_marks():
    encoder, asked = tokens.TextEncoder(P.path("word_bpe_49k.json")), []

    class Asked:
        def encode_batch_fast(self, texts, **options):
            asked.extend(w for t in texts for w in t.split())
            return library.encode_batch_fast(texts, **options)

        def encode(self, text, **options):
            asked.extend(text.split())
            return library.encode(text, **options)

    library, encoder.tokenizer = encoder.tokenizer, Asked()
    texts = ["Übung übung übung!! ÜBUNG***", "word Word, WORD. Übung.", "WORD!! word***"]
    assert column_ids(encoder, texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert sorted(asked) == ["!!", "***", ",", ".", "word", "übung"]


def test_pieces_are_handed_over_in_small_batches(spark, monkeypatch):
    texts = [None, "a " * 5000, "b", "", "c " * 4096, "d " * 2047]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    want = {(d, k): (k * 2048, min(2048, n - k * 2048)) for d, n in enumerate([1, 5001, 2, 1, 4097, 2048]) for k in range(-(-n // 2048))}
    for flushed in (packing.FLUSHED, 3000):
        monkeypatch.setattr(packing, "FLUSHED", flushed)
        rows = packing.packed_documents(docs, P.path("word_bpe_49k.json")).collect()
        assert {(r["doc_id"], r["piece"]): (r["start"], r["length"]) for r in rows} == want and len(rows) == len(want)
        assert all(len(r["ids"]) == 4 * r["length"] and r["ids_crc32"] == zlib.crc32(r["ids"]) for r in rows)
        ends = {(r["doc_id"], r["piece"]) for r in rows if r["ids"][-4:] == bytes(4)}
        assert ends == {max(k for k in want if k[0] == d) for d in range(len(texts))}


def test_packing(spark, sf_dir):
    rows = registry.op3_best_fit_packing(spark, sf_dir).collect()
    spans = collections.defaultdict(list)
    for r in rows:
        spans[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in spans.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(spans) <= 1.02 * -(-sum(r["length"] for r in rows) // 2048) + 1
    for counts in ({}, {2048: 9}, {1500: 7, 600: 3, 300: 1}, {n: 3 for n in range(1, 2049, 7)}, {700: 10**9, 1300: 10**9}):
        held = collections.Counter()
        for pattern, times in packing.plan(counts):
            assert sum(n * k for n, k in pattern) <= 2048
            for n, k in pattern:
                held[n] += k * times
        assert held == counts


def test_packing_pivots_to_the_optimum():
    """Thirty triples that fill a sequence, a million of each: the program's optimum is as many sequences, and rounding costs a few."""
    rng, counts = np.random.default_rng(2), collections.Counter()
    for _ in range(30):
        a, b = rng.integers(550, 740, 2).tolist()
        counts.update({n: 10**6 * k for n, k in collections.Counter((a, b, 2048 - a - b)).items()})
    runs = packing.plan(counts)
    assert sum(n for _, n in runs) <= 30 * 10**6 + len(counts)
    held = collections.Counter()
    for pattern, times in runs:
        for n, k in pattern:
            held[n] += k * times
    assert held == counts
    same = {700: 4, 600: 4, 500: 2}  # as many sequences either way: the grouped plan is taken
    assert packing.plan(same) == packing.grouped_plan(same, 2048, *packing.GRAINS[0]) and packing.GRAINS[0][0] > 2


def test_packing_query_packs_the_ids(spark, sf_dir, docs, monkeypatch):
    from tokenizers import Tokenizer

    library, given, pack = Tokenizer.from_file(P.path("word_bpe_49k.json")), [], packing.pack
    monkeypatch.setattr(packing, "pack", lambda pieces, *a: given.append(pieces.columns) or pack(pieces, *a))
    rows = registry.op3_best_fit_packing(spark, sf_dir).collect()
    assert "ids" in given[0] and "ids_crc32" not in given[0]
    want = {}
    for d, text in docs.items():
        ids = [*library.encode(text, add_special_tokens=False).ids, 0]
        want.update({(d, k // 2048): (k, len(ids[k : k + 2048]), zlib.crc32(np.asarray(ids[k : k + 2048], "<u4").tobytes())) for k in range(0, len(ids), 2048)})
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want and len(rows) == len(want)


def test_pack_takes_any_columns(spark, monkeypatch):
    pieces = spark.range(500).selectExpr("id % 300 + 1 AS length", "id AS part", "id + 1 AS _place", "-id AS _bases", "id * 2 AS base").repartition(7)
    for few in (1_000_000, 10):
        monkeypatch.setattr(packing, "SMALL_BASES", few)
        rows = packing.pack(pieces, 2048).collect()
        assert sorted((r["length"], r["part"], r["_place"], r["_bases"], r["base"]) for r in rows) == sorted(tuple(r) for r in pieces.collect())
        spans = collections.defaultdict(list)
        for r in rows:
            spans[r["sequence_id"]].append((r["offset"], r["length"]))
        for own in spans.values():
            assert [o for o, _ in sorted(own)] == [0, *np.cumsum([n for _, n in sorted(own)])[:-1].tolist()] and sum(n for _, n in own) <= 2048


def test_shards(spark, sf_dir, docs):
    rows = sorted(sharding.balanced_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), 5).collect())
    sizes, seen = collections.Counter(), collections.Counter()
    for r in rows:
        data = docs[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(data) + 8, zlib.crc32(data))
        assert r["slot"] == seen[r["shard"]]
        seen[r["shard"]] += 1
        sizes[r["shard"]] += r["size"]
    assert [r["shard"] for r in rows] == sorted(r["shard"] for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r["size"] for r in rows)


def test_wavelet_answers():
    rng = np.random.default_rng(3)
    for n in (1, 600, 5000):
        ids = rng.integers(0, 50, n).astype("<u2")
        _, _, matrix = wavelet.open_shard(wavelet.pack_shard([1], [n], ids, 16))
        assert (matrix.decode() == ids).all()
        for i in rng.integers(0, n, 20).tolist():
            token, nth = int(ids[i]), int((ids[:i] == ids[i]).sum())
            assert matrix.access(i) == token and matrix.count(token) == (ids == token).sum() and matrix.occurrence(token, nth) == i
        assert matrix.count(60000) == 0


def test_line_dedup_deletes_later_passages_only(spark):
    own = [" ".join(f"d{i}x{j}" for j in range(30)) for i in range(4)]
    parts = [PASSAGE[: len(PASSAGE) // 2].strip(), PASSAGE[len(PASSAGE) // 2 :].strip()]
    texts = [f"{own[0]}\n{PASSAGE}", f"{own[1]}\n{PASSAGE}\ntail of one", f"short line\n{parts[0]}\n{parts[1]}\n{own[2]}", f"{own[3]}\n{parts[0]}\n\n{parts[1]}", "short line\nmore", PASSAGE]
    got = [r["text"] for r in sorted(linededup.dedup_report(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect())]
    assert got == [texts[0], f"{own[1]}\ntail of one", texts[2], f"{own[3]}\n", texts[4], ""]
    assert linededup.dedup_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).count() == 5


def test_line_dedup_guarantee(spark, sf_dir, docs):
    """Every window of 50 words that an earlier place has is gone; what goes has an equal line before it."""
    left = {r["doc_id"]: collections.Counter(x.strip() for x in (r["text"] or "").split("\n")) for r in registry.op5_line_dedup(spark, sf_dir).collect()}
    seen, before = set(), set()
    for i in sorted(docs):
        lines = [x.strip() for x in docs[i].split("\n") if x.split()]
        must = set()
        for a, e in enumerate(linededup.ends([len(x.split()) for x in lines], 50)):
            if e > 0:
                must |= set(range(a, e)) if tuple(lines[a:e]) in seen else set()
                seen.add(tuple(lines[a:e]))
        gone = collections.Counter(lines) - left[i]
        assert not collections.Counter(lines[x] for x in must) - gone
        assert all(x in before or lines.count(x) > 1 for x in gone)
        before |= set(lines)


def test_line_dedup_leaves_shorter_runs(spark):
    def words(name, n):
        return " ".join(f"{name}{i}" for i in range(n))

    short, almost, just, head, tail = words("s", 29), [words("a", 20), words("b", 29)], [words("c", 20), words("d", 30)], words("h", 3), words("t", 9)
    texts = [[short], [*almost, "-" * 9], [head, *just, tail], [words("x", 40), short, words("y", 40)], [words("z", 40), *almost, words("v", 40)], [words("u", 40), head, *just, tail, "end"], [just[1], *almost, just[0]]]
    texts = ["\n".join(x) for x in texts]
    got = [r["text"] for r in sorted(linededup.dedup_report(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect())]
    assert got == [*texts[:5], words("u", 40) + "\nend", texts[6]]


def test_line_dedup_is_exact(spark, sf_dir, docs):
    """A line goes just if it is in a run of 50 words or more that an earlier place has."""
    seen, want = set(), {}
    for i in sorted(docs):
        lines = [(n, x.strip()) for n, x in enumerate(docs[i].split("\n")) if x.split()]
        gone = set()
        for a in range(len(lines)):
            total = 0
            for e in range(a, len(lines)):
                before, total = total, total + len(lines[e][1].split())
                run = tuple(x for _, x in lines[a : e + 1])
                if total >= 50:
                    gone |= {n for n, _ in lines[a : e + 1]} if run in seen else set()
                    seen.add(run)
                if before >= 50 + 50:
                    break
        want[i] = len(gone)
    assert {r["doc_id"]: r["n_gone"] for r in registry.op5_line_dedup(spark, sf_dir).collect()} == want


def test_main_text(spark):
    page = """<html><head><title>t</title><script>var t="</p>"</script></head><body><nav><a href=x>Home</a></nav><div class="ad">Buy the best of all the things</div>
    <article><header class="entry-header"><h1>A &amp; B</h1></header><p>One\n two<br>three<p>Four</article><div id="comments"><p>I like the text and all of it</p></div><aside>x</aside><footer>f</footer>"""
    story = "This is the text of the story and it is long enough to be good in every way. " * 3
    plain = f"<div><p><a href=x>Home</a> | <a href=y>News</a></p><p>{story}</p><p>Short.</p><p>{story}</p></div><form><p>{story}</p></form>"
    assert htmltext.main_text(page) == "A & B\nOne two three\nFour"
    assert htmltext.main_text(plain) == "\n".join([story.strip(), "Short.", story.strip()])
    odd = spark.createDataFrame([(1, "u", None), (2, None, ""), (3, "u", "<p"), (None, "u", "<article>x" + "<div>" * 3000)], "page_id bigint, url string, html string")
    assert sorted(r["text"] for r in htmltext.extract_report(odd).collect()) == ["", "", "", "x"]
    assert htmltext.extract_report(odd.limit(0)).count() == 0


def test_main_text_closes_what_html_closes():
    story = "<article><p>One of the two<p>and the other</article>"
    cells = "<table><tr>" + "<td>cell" * 300 + "</table>"
    assert htmltext.main_text(f"<aside>{cells}</aside>{story}") == "One of the two\nand the other"
    assert htmltext.main_text(f"<article><p>Own text{cells}</article><p>© not of the article") == "Own text\n" + "\n".join(["cell"] * 300)
    assert htmltext.main_text(f"<aside>{'<div>' * 300}x</aside>{story}") == "One of the two\nand the other"
    for open_tag in ("<head><title>t</title><meta charset=x>", "<div><button>Go</div>", "<div><select><option>a<option>b</div>", "<div><form><input></div>", "<form><input>", "<noscript>", "<svg/>", "<form><input>" + story + "<form>x</form>"):
        assert htmltext.main_text(f"{open_tag}{story}").endswith("One of the two\nand the other"), open_tag
    assert htmltext.main_text(f"<form><div>{story}</form>") == htmltext.main_text(f"<script>{story}") == ""
    assert htmltext.main_text("<article>" + "<button>x" * 20000).split() == ["x"] * 20000


def test_main_text_weighs_regions_and_densities():
    story = ("This is the text of the story and it is long enough to be good in every way. " * 3).strip()
    middle = "It has one more paragraph of middle length, and that is a part of the story too."
    want = f"Title\n{story}\n{middle}\nShort.\n{story}"
    body = f"<h1>Title</h1><p>{story}</p><p>{middle}<p>Short.</p><p>{story}</p>"
    for around in ("<div class='wrapper has-sidebar'>{}</div>", "<div class='wrapper has-sidebar'><article>{}</article></div>", "<main class='site-main right-sidebar'>{}</main>", "<div class='wrapper has-sidebar'><article><header>{}</article></div>"):
        page = f"<nav>Home</nav>{around.format(body)}<div class=ad>Buy the best of all the things</div><div class=sidebar><p>{middle}</p></div><footer>{story}</footer>"
        assert htmltext.main_text(page) == want, around
    lost = f"<div class='wrapper has-sidebar'><article><p>{middle}</article></div><aside>{story}</aside>"
    assert htmltext.main_text(lost) == middle
    links = "<p><a href=x>A headline of another page, which is about what was in the news today, and more</a></p>"
    for around in ("<main>{}</main>", "<article>{}</article>", "<div class=content>{}</div>"):
        assert htmltext.main_text(around.format(f"<p>{middle}</p>{links}<p>Short.</p>")) == f"{middle}\nShort."
        assert htmltext.main_text(around.format("<p>Only <a href=x>half a link</a></p>")) == "Only half a link"
    assert htmltext.main_text(f"<article><p>{middle}</article><div id=comments><p>Yes, I like it<p>{middle}<p>No</div>") == middle


def test_main_text_leaves_out_long_comments_adverts_sidebars_and_notices():
    story = ("This is the text of the story and it is long enough to be good in every way. " * 3).strip()
    said = ("I think that this is one of the best things that I have ever read, and I would like to thank you for it. " * 3).strip()
    outs = ["<div id=comments><div class=comment><p>{}</div></div>", "<section class='widget comments-area'><ol class=comment-list><li><article class='comment-body'><p>{}</article></ol></section>", "<ul class=comments><li>{}</ul>", "<div itemprop=comment><p>{}</div>",
            "<div class=ad><p>{}</div>", "<div class='box Sidebar'><div><p>{}</div></div>", "<div class='cookie-notice'><p>{}</div>", "<section role=complementary><p>{}</section>", "<div class=notice>{}</div>"]
    for out in outs:
        for page in (f"<article><p>{story}</article>{out}", f"<article><p>{story}{out}</article>", f"{out}<div><p>{story}</div>", f"<div class=content>{out}<p>{story}</div>"):
            assert htmltext.main_text(page.format(said)) == story, page
    for own in ("<body class='comments-open'><p>{}", "<article class='post has-comments'><p>{}</article>", "<div class='layout sidebar'><main><p>{}</main></div>", "<div class=notice><article><p>{}</article></div>", "<article class=notice><p>{}</article>", "<section id=discussion><p>{}</section>", "<article><p>Code: <span class=comment>{}</span></article>"):
        assert htmltext.main_text(own.format(story)).endswith(story), own


def test_main_text_of_all_pages(spark, sf_dir):
    """Against the standard library's parser: the blocks of the article, and no more."""
    from html.parser import HTMLParser

    class Article(HTMLParser):
        def __init__(self):
            super().__init__()
            self.inside, self.out, self.parts = 0, [], []

        def cut(self):
            text = " ".join("".join(self.parts).split())
            self.out += [text] if text and self.inside else []
            self.parts = []

        def handle_starttag(self, tag, attrs):
            if tag in htmltext.BLOCK:
                self.cut()
            self.inside += tag == "article"
            self.parts.append(" " if tag == "br" else "")

        def handle_endtag(self, tag):
            if tag in htmltext.BLOCK:
                self.cut()
            self.inside -= tag == "article"

        def handle_data(self, data):
            if self.cdata_elem is None:
                self.parts.append(data)

    pages = {r["page_id"]: r["html"] or "" for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = registry.op6_main_text(spark, sf_dir).collect()
    assert len(rows) == len(pages)
    for r in rows:
        own = Article()
        own.feed(pages[r["page_id"]])
        own.close()
        own.cut()
        assert r["text"] == "\n".join(own.out) and r["n_chars"] == len(r["text"])
    counts = np.array([htmltext.decided(x) for x in pages.values()]).sum(axis=0)
    assert counts[1] > counts[2] > 0  # densities decide more blocks than neighbours do


HOSTILE = ["<div class=a ", "<a '", "<a x='", "<a x='>", "<a x=\"'>", "<p y='\">z", "<script", "</script", "<script></script ", "<button ", "<button>", "<select><option ", "<form>", "</form ", "<!--", "<![CDATA[", "<svg>", "<td>", "<table>", "<ul><li>", "<span class=ad>", "</p>", "<p>a", "&amp", "&#", "_nav", "<div class='_nav_nav", "< <<", "<a x = ", "x=' '"]


def test_main_text_is_read_in_linear_time():
    import time

    for bit in HOSTILE:
        for page in (bit * (1_000_000 // len(bit)), f"<article><p>{bit * (500_000 // len(bit))}</article>>'\"" + bit * (500_000 // len(bit))):
            began = time.process_time()
            htmltext.main_text(page)
            assert time.process_time() - began < 8, bit
    story = ("This is the text of the story and it is long enough to be good in every way. " * 3).strip()
    assert htmltext.main_text(f'<p title="abc>{story}</p><p>End.') == f"{story}\nEnd."
    assert htmltext.main_text(f'<p title="a > b" data-x=\'</p>"\'>{story}</p>') == story
    assert htmltext.main_text(f"<p it's>{story}</p><p>{story}</p>") == f"{story}\n{story}"


def test_main_text_rows(spark):
    story = ("This is the text of the story and it is long enough to be good in every way. " * 3).strip()
    long = "<article>" + f"<p>{story}" * 5000 + "</article>"
    rows = [(1, "u", f"<p>{story}", 3, "t"), (1, "u", f"<p>{story}", 3, "t"), (2, "v", long, 1, "t"), (None, None, None, None, None)]
    got = sorted((r["page_id"] or 0, r["url"], r["n_chars"]) for r in htmltext.extract_report(spark.createDataFrame(rows, "page_id bigint, url string, html string, n_chars int, text string")).collect())
    assert got == [(0, None, 0), (1, "u", len(story)), (1, "u", len(story)), (2, "v", 5000 * len(story) + 4999)]


def test_fingerprint_estimates_likeness(spark, sf_dir, docs):
    def shingles(text):
        w = WORDS(text)
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    rows = {r["doc_id"]: r for r in registry.op7_minhash_fingerprint(spark, sf_dir).collect()}
    order = sorted(docs, reverse=True)
    off = []
    for i, d in enumerate(order):
        text, after = docs[d], docs[order[(i + 1) % len(order)]]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert rows[d]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b = shingles(text), shingles(edited)
        off.append(rows[d]["near_edited"] - (len(a & b) / len(a | b) if a | b else 1))
    assert abs(np.mean(off)) < 0.02 and np.std(off) < 0.08
    by_text = collections.defaultdict(set)
    for d, r in rows.items():
        by_text[docs[d]].add(r["fingerprint"])
    assert all(len(x) == 1 for x in by_text.values())


def test_large_groups_of_near_copies_are_verified_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(lshforest, "BLOCK", 8)
    base = [f"w{i}" for i in range(80)]
    texts = [" ".join(base[:i] + [f"e{i}"] + base[i + 1 :]) for i in range(40)]
    got = {r["doc_id"]: r for r in lshforest.class_report(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    sets = [{tuple(t.split()[i : i + 5]) for i in range(76)} for t in texts]
    links = collections.Counter()
    for a, b in itertools.combinations(range(40), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            links[a] += 1
            links[b] += 1
    assert {i: r["n_links"] for i, r in got.items()} == {i: links[i] for i in range(40)}
    assert {r["class_id"] for r in got.values()} == {0}


def jaccard_pairs(texts, threshold=0.8):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in map(str.split, texts)]
    return [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if 10 * len(sets[a] & sets[b]) >= round(10 * threshold) * len(sets[a] | sets[b])]


def test_forest_shortens_prefixes_by_what_it_finds(spark, monkeypatch):
    def searched(texts):
        trace = []
        rows = lshforest.jaccard_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), trace=trace).collect()
        want = collections.Counter(x for p in jaccard_pairs(texts) for x in p)
        assert {r["_id"]: r["n_links"] for r in rows} == {i: want[i] for i in range(len(texts))}
        return trace

    words = lambda name, n: [f"{name}{i}" for i in range(n)]
    close = [" ".join([*words(f"a{g}x", 600), f"e{k}"]) for g in range(20) for k in range(3)]
    trace = searched(close)
    assert [d for d, _, _ in trace] == [lshforest.DEEPEST] and trace[-1][2] >= lshforest.TARGET
    apart = []
    for g in range(40):  # pairs just over the threshold, and a group whose members are alike two by two
        base = words(f"b{g}x", 180)
        apart += [" ".join(base), " ".join([*base[:158], *words(f"c{g}x", 12)])]
    apart += [" ".join([*words("d", 200), *tail]) for tail in (["p"], ["p"] * 2, words("q", 20), [*words("q", 20), "r"])]
    for block in (512, 2):
        monkeypatch.setattr(lshforest, "BLOCK", block)
        trace = searched(apart)
        assert [d for d, _, _ in trace][0] == lshforest.DEEPEST and trace[-1][0] == lshforest.last_depth() and len(trace) > 1
        assert [n for _, n, _ in trace] == sorted(n for _, n, _ in trace)


def test_tries_give_the_longest_matched_prefix(spark):
    rng = np.random.default_rng(4)
    labels = rng.integers(0, 2, (300, 3, 4)).astype("<u2")  # few values, so that prefixes match
    texts = spark.createDataFrame([(bytes([i // 256, i % 256]), x.tobytes()) for i, x in enumerate(labels)], "h binary, labels binary").repartition(5)
    got = {(r["t"], bytes(r["h"])): r["reach"] for r in lshforest.matched_prefixes(texts, 3, 4, 1).collect()}
    over = 0
    for t in range(3):
        for i in range(300):
            same = np.cumprod(labels[:, t] == labels[i, t], axis=1).sum(axis=1)
            best, found = np.delete(same, i).max(), got.get((t, bytes([i // 256, i % 256])), 0)
            assert found >= best
            over += found != best
    assert over <= 2 * 8  # the ends of partitions


def test_forest_expectations():
    bins = [0] * lshforest.BINS
    assert lshforest.next_depth(bins, 8, 5, 0.8, 0.9995, 20) == 5
    bins[-1] = 10
    assert lshforest.next_depth(bins, 8, 5, 0.8, 0.9995, 20) == 8
    bins[0] = 1000
    assert lshforest.next_depth(bins, 8, 5, 0.8, 0.9995, 20) == 5 and abs(lshforest.expected(bins, 8, 8, 0.8, 20) - lshforest.chance(0.8, 8)) < 0.01


def test_ids_that_are_no_integers_are_refused(spark):
    with pytest.raises(TypeError, match="doc_id must be an integer"):
        lshforest.class_report(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_one_of_each_keeps_wordless_and_repeated(odd):
    kept = lshforest.one_of_each(odd)
    assert kept.columns == odd.columns
    assert kept.where("text like 'same words%'").count() == 1
    assert kept.where("text = 'a'").count() == 1
    assert kept.where("trim(coalesce(text, '')) = ''").count() == 3


def test_pipeline_stages(spark, sf_dir):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    good = pipeline.quality(spark, docs, sf_dir)
    wanted = {r["doc_id"] for r in hostrules.quality_report(docs).where("kept").collect()}
    assert good.columns == docs.columns and {r["doc_id"] for r in good.collect()} == wanted
    once = pipeline.near_duplicates(spark, docs, sf_dir)
    classes = {r["doc_id"]: r["class_id"] for r in lshforest.class_report(docs).collect()}
    assert {r["doc_id"] for r in once.collect()} == {i for i, c in classes.items() if i == c}
    packed = pipeline.run(spark, sf_dir)
    assert packed.count() > 0 and packed.where("octet_length(ids) <> 4 * length").count() == 0


def test_hot_host_and_shrinking(spark):
    bad, good = "x", " ".join(f"w{i}" for i in range(40))
    rows = [(i, bad if i % 10 else good, "junk") for i in range(200)] + [(1000 + i, good, "fine") for i in range(400)] + [(2000, bad, "tiny"), (2001, good, "tiny"), (2002, good, None)]
    got = {r["doc_id"]: r["kept"] for r in hostrules.quality_report(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    assert not got[0] and got[1000] and got[2001] and got[2002]


def test_rules_are_shrunk_by_host(spark):
    """Rates by hand, and a host that one rule alone rejects."""
    good, symbols = " ".join(f"w{i}" for i in range(40)), " ".join(f"w{i}#" for i in range(40))
    rows = [(i, symbols, "marks") for i in range(90)] + [(100 + i, good, "marks") for i in range(10)] + [(1000 + i, good if i % 20 else "x", f"h{i % 5}") for i in range(500)]
    measured = hostrules.measure(spark.createDataFrame(rows, "doc_id bigint, text string, source string"))
    got = {r["_host"]: r for r in hostrules.host_verdicts(measured).collect()}
    assert [h for h, r in got.items() if r["rejected"]] == ["marks"] and got["marks"]["rates"]["symbols"]["fails"] == 90
    for rule in (*hostrules.RULES, "any"):
        counts = {h: (r["rates"][rule]["fails"], r["n"]) for h, r in got.items()}
        n, m = sum(b for _, b in counts.values()), sum(a for a, _ in counts.values()) / sum(b for _, b in counts.values())
        v, c = sum(a * a / b for a, b in counts.values()) / n - m * m, m * (1 - m) * len(counts) / n
        weight = max(1.0, m * (1 - m) / (v - c) - 1) if v > c and m * (1 - m) > v else 100.0
        for h, (a, b) in counts.items():
            assert got[h]["rates"][rule]["shrunk"] == pytest.approx((a + m * weight) / (b + weight))
    kept = {r["doc_id"]: r["kept"] for r in hostrules.quality_report(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    assert not any(kept[i] for i in range(90)) and not kept[105] and kept[1001]
    assert kept == dict(duck_over(registry.OP10, documents=(rows, ["doc_id", "text", "source"]), columns=("doc_id", "kept")))


def duck_over(sql, columns, **tables):
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    for name, (rows, names) in tables.items():
        con.register(name, pd.DataFrame(rows, columns=names))
    return con.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()


CLASH = "doc_id bigint, text string, source string, _k int, _t int, _h int, gone int, n_gone int, _c0 int, row int, `a.b` int, k int, first int, _kept int, n_chars int"


def test_stages_keep_columns_of_any_name(spark):
    own = " ".join(f"o{i}" for i in range(60))
    texts = [f"{PASSAGE}\n{own}", f"{own} x\n{PASSAGE}", None, "tiny", PASSAGE + " y"]
    rows = [(i, t, "s", *range(10 * i, 10 * i + 11), 5) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[0]], CLASH)
    for stage in (hostrules.keep_good, linededup.dedup_documents, lshforest.one_of_each):
        made = stage(docs)
        assert made.columns == docs.columns and stage(docs.limit(0)).count() == 0
        for r in made.collect():
            assert tuple(r[3:14]) == rows[r["doc_id"]][3:14], stage
    assert sorted(r["doc_id"] for r in hostrules.keep_good(docs).collect()) == [0, 0, 1, 4]
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in linededup.dedup_documents(docs).collect()}
    assert got[1] == (f"{own} x", len(own) + 2) and got[0] == (texts[0], 5) and got[2] == (None, 5)
    assert sorted(r["doc_id"] for r in lshforest.one_of_each(docs).collect()) == [0, 2, 3, 4]  # 0 and 1 are near copies


def test_hot_runs_meet_a_broadcast(spark, monkeypatch):
    from tokenloom.llm import common

    rows = [(i, f"own {i}\n{PASSAGE}") for i in range(30)] + [(100 + i, f"{' '.join(f'z{j}' for j in range(70))}\n{i}") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = sorted(tuple(r) for r in linededup.dedup_report(docs).collect())
    for hot, few in ((10, 100), (10, 0), (1, 100)):
        monkeypatch.setattr(common, "HOT", hot)
        monkeypatch.setattr(common, "FEW_HOT", few)
        assert sorted(tuple(r) for r in linededup.dedup_report(docs).collect()) == want
    assert sum(r[3] for r in want) == 29 + 2


def test_a_cluster_must_name_its_shared_folder():
    from types import SimpleNamespace

    from tokenloom.llm import common

    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="spark://x", getConf=lambda: SimpleNamespace(get=lambda *a: None)))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(session)


def test_wavelet_queries_over_files(spark):
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 30, n)) for n in rng.integers(0, 60, 40)]
    rows = [(None if i % 9 == 0 else f"d{i // 2:03}", t) for i, t in enumerate(texts)]  # null and repeated string ids
    docs = spark.createDataFrame(rows, "doc_id string, text string").coalesce(1)
    made = wavelet.write_shards(docs, P.path("byte_bpe_50k.json"), 2, shard_tokens=200)
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or "", i))
    whole, starts = [], []
    for i in order:
        starts.append((rows[i][0], len(whole)))
        whole += [*library.encode(texts[i], add_special_tokens=False).ids, 2]
    read = wavelet.read_shards(made.drop("n_tokens", "n_docs"), "string").collect()
    assert sorted(((r["doc_id"], r["start"]) for r in read), key=str) == sorted(starts, key=str)
    assert np.concatenate([np.frombuffer(r["ids"], "<u4") for r in sorted(read, key=lambda r: r["start"])]).tolist() == whole
    assert made.count() > 3
    at = rng.integers(0, len(whole), 25).tolist()
    assert {(r["position"], r["token"]) for r in wavelet.tokens_at(made, [*at, len(whole)]).collect()} == {(p, whole[p]) for p in at}
    some = whole[:7]
    assert {r["token"]: r["n"] for r in wavelet.token_counts(made, [*some, 49999]).collect()} == {**{t: whole.count(t) for t in some}, 49999: 0}
    assert sorted(r["position"] for r in wavelet.token_positions(made, some[0]).collect()) == [i for i, t in enumerate(whole) if t == some[0]]
    assert wavelet.tokens_at(made.limit(0), [1]).count() == 0


def test_one_access_reads_a_chunk_of_each_plane():
    ids = np.random.default_rng(2).integers(0, 8, 2_000_000).astype("<u2")
    data, asked = wavelet.pack_shard([1], [len(ids)], ids), []
    shard = wavelet.Shard(lambda at, size: asked.append(size) or data[at : at + size])
    matrix = shard.matrix()
    assert matrix.access(524_288) == ids[524_288] and sum(asked) < len(data) / 3
    assert matrix.access(1_999_999) == ids[-1] and (matrix.decode() == ids).all()


def test_wavelet_shards_give_the_librarys_ids(spark, odd):
    import zlib

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = sorted(((r["doc_id"], r["text"] or "") for r in odd.where("doc_id is not null").collect()), key=lambda r: r[0])
    start, want = 0, []
    for doc_id, text in rows:
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        want.append((doc_id, start, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())))
        start += len(ids)
    for size in (4_000_000, 100):  # files of one document or a few, and one file a partition
        read = wavelet.read_shards(wavelet.write_shards(odd.where("doc_id is not null"), P.path("byte_bpe_50k.json"), 2, shard_tokens=size)).collect()
        got = [(r["doc_id"], r["start"], len(r["ids"]) // 4, zlib.crc32(r["ids"])) for r in read]
        assert sorted((g[0], *g[2:]) for g in got) == sorted((w[0], *w[2:]) for w in want) and sorted(g[1] for g in got) == sorted(w[1] for w in want)


def test_wavelet_query_on_whole_documents(spark, sf_dir, docs):
    import zlib

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    start, want = 0, []
    for doc_id in sorted(docs):
        ids = [*library.encode(docs[doc_id], add_special_tokens=False).ids, 2]
        want.append((doc_id, start, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r[c] for c in ("doc_id", "start", "n_tokens", "ids_crc32")) for r in registry.op8_wavelet_shards(spark, sf_dir).collect()) == want
