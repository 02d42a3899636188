"""Parts that need no Spark."""

import io
import random
import struct
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewheel.llm import edit, huffman, linkage, warc
from tidewheel.llm.charsmap import CharsMap, normalise
from tidewheel.llm.edit import within
from tidewheel.llm.htmltext import text_of
from tidewheel.llm.neardup import shard_keys
from tidewheel.llm.queries import tokenizer_file
from tidewheel.llm.rtree import CountRTree, overlap_needed, point


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=1, max_size=2000))
def test_huffman_round_trip(ids):
    ids = np.array(ids)
    lengths = huffman.code_lengths(np.bincount(ids, minlength=61), 7)
    assert lengths.max() <= 7 and sum(2.0 ** -int(n) for n in lengths if n) <= 1
    got = huffman.read_file(huffman.write_file(huffman.Codec(lengths), [1, None], np.array([1, len(ids) - 1]), ids))
    assert got[0] == [1, None] and got[2].tolist() == ids.tolist()


def test_huffman_blocks_decode_alone():
    ids = np.random.default_rng(1).integers(0, 300, huffman.BLOCK * 2 + 77)
    data = huffman.write_file(huffman.Codec(huffman.code_lengths(np.bincount(ids))), [1], np.array([len(ids)]), ids)
    for k in range(3):
        assert huffman.read_block(data, k).tolist() == ids[k * huffman.BLOCK : (k + 1) * huffman.BLOCK].tolist()
    with pytest.raises(ValueError):
        huffman.read_file(data[:-9] + b"x" + data[-8:])


@pytest.mark.parametrize("level", [1, None])
def test_salvage(level):
    parts = [warc.encode([("WARC-Type", "resource"), ("WARC-Record-ID", f"<{i}>")], b"body %d " % i * 50, level) for i in range(6)]
    broken = bytearray(parts[2])
    broken[len(broken) // 2] ^= 255
    data = parts[0] + b"junk" + parts[1] + bytes(broken) + parts[3] + parts[4][: len(parts[4]) // 2] + parts[5]
    found = list(warc.read(io.BytesIO(data)))
    assert [x.headers["warc-record-id"] for x in found if isinstance(x, warc.Record)] == ["<0>", "<1>", "<3>", "<5>"]
    gaps = [(x.start, x.end) for x in found if isinstance(x, warc.Gap)]
    assert len(gaps) == 3 and sum(e - s for s, e in gaps) == 4 + len(broken) + len(parts[4]) // 2


def _trie(rules):
    """A compiled character map of one-byte keys, built by hand: the root's children at 256 + byte."""
    pool, units = b"", [0] * 1024
    units[0] = 256 << 10
    for k, v in rules.items():
        node, leaf = 256 ^ k, 512 ^ k
        units[node] = ((node ^ leaf) << 10) | 1 << 8 | k
        units[leaf] = 1 << 31 | len(pool)
        pool += v + b"\0"
    return struct.pack("<I", 4096) + struct.pack("<1024I", *units) + pool


def test_character_map_aligns():
    chars = CharsMap(_trie({ord("A"): b"aa", ord("!"): b""}))
    out, source = normalise("xA!é", chars, True, False, True)
    assert out.decode() == "▁xaaé"
    assert source.tolist() == [0, 0, 0, 0, 1, 1, 3, 3, 5]


def test_pieces_as_the_library():
    from tidewheel.llm.pieces import PieceCodec

    c = PieceCodec(tokenizer_file("piece_bpe_32k.model"))
    odd = ["", " ", "a  b", "a\nb", "\na", "a\n", "a \n b", "tab\tx", "x▁y", "日本 語\n😀 z", "<s> </s>", "a\0b", "   ", "don't stop.\nNow"]
    for text, e in zip(odd, c.encode(odd), strict=True):
        assert e.ids.tolist() == c.lib.encode(text)
        assert not len(e.ends) or e.ends[-1] == len(text.encode())


def test_byte_bpe_as_the_library():
    from tidewheel.llm.tokenstore import ByteBpe

    b = ByteBpe(tokenizer_file("byte_bpe_50k.json"))
    odd = ["", " ", "a  b", "it's x!?", "a\n\nb ", "é,ß... #%x", "日本 語\n😀", "x <|endoftext|> y", "word*** | x", " lead", "\x85 z"]
    for text, got in zip(odd, b.encode(odd), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == b.tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.text("abé", max_size=12), st.text("abé", max_size=12), st.integers(0, 8))
def test_edit_distance(a, b, k):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    assert within(a, b, k) == (row[-1] <= k)


@pytest.mark.parametrize("percent", [80, 90])
def test_sets_that_link_share_a_shard_and_the_tree_finds_them(percent):
    rng = random.Random(percent)
    for n in [1, 2, 5, 6, 9, 12, 13, 19, 40, 150, 600]:
        for _ in range(12):
            a = {rng.getrandbits(64) for _ in range(n)}
            drop = rng.randrange(0, max(1, n * (100 - percent) // 100 + 1))
            b = set(list(a)[drop:]) | {rng.getrandbits(64) for _ in range(rng.randrange(0, drop + 2))}
            x, y = (np.array(sorted(s), np.uint64) for s in (a, b))
            if len(a & b) >= int(overlap_needed(np.int64(len(a) + len(b)), percent)) and b:
                assert set(shard_keys(x, percent).tolist()) & set(shard_keys(y, percent).tolist())
                others = [point(np.array([rng.getrandbits(64) for _ in range(n + 1)], np.uint64)) for _ in range(40)]
                _, p = CountRTree(np.stack([*others, point(x)])).search(point(y)[None], percent)
                assert 40 in p.tolist()


@pytest.mark.parametrize("page", ["<a '" * 250_000, "<a '" * 250_000 + ">", "<a '>' " * 140_000, "<div>" * 50_000 + "</span>" * 100_000, "<b>" * 100_000 + "<p>x</p>" * 50_000, "</a '" * 200_000 + ">", "<!x" * 300_000])
def test_malformed_pages_take_linear_time(page):
    import time

    began = time.process_time()
    text_of(page)
    assert time.process_time() - began < 4


def test_html():
    page = "<head><title>no</title></head><div class='cookie-notice'>no</div><article><header><h1>A &amp; B</h1></header><p>one<br>two<p>three <b>bold</b><script>if (a<b) '</p>'</script><div id=comments>no</div></article><footer>no"
    assert text_of(page)[0] == "A & B\none two\nthree bold"
    assert text_of("")[0] == "" and text_of("<p>only")[0] is None


def test_unlike_long_lines_cost_no_edit_distance(monkeypatch):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghiéß中\U0001f600") for _ in range(rng.randrange(1, 9)))
    shared = " ".join(word() for _ in range(8))
    texts = [" ".join([word() for _ in range(60)] + [shared] + [word() for _ in range(60)]) for _ in range(40)]
    for t in texts[:20]:  # a like one, its edits anywhere
        u = list(t)
        for _ in range(rng.randrange(len(t) // 5)):
            u[rng.randrange(len(u))] = rng.choice(["", "x", "yy"])
        texts.append("".join(u))
    texts += ["".join(rng.choice("ab") for _ in range(n)) for n in (0, 1, 2, 5, 63, 64, 65, 128, 129) for _ in range(2)]
    x, y = np.array([(i, j) for i in range(len(texts)) for j in range(len(texts)) if i != j]).T
    size = np.array([len(t) for t in texts])
    most = np.maximum(size[x], size[y]) // 5
    want = [edit.within(texts[i], texts[j], int(k)) for i, j, k in zip(x, y, most, strict=True)]
    calls = []
    monkeypatch.setattr(edit, "within", lambda a, b, k, of=edit.within: calls.append(a) or of(a, b, k))
    assert edit.Texts(texts).within(x, y, most).tolist() == want and sum(want) >= 30
    assert len(calls) < len(x) // 8


def test_like_long_lines_are_compared_at_once(monkeypatch):
    """Distances of many pairs, exact up to ``most`` and above it beyond; a word more at the start, so that words in the same places tell nothing."""
    rng = random.Random(6)
    texts = [" ".join("".join(rng.choice("abcdeß中") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(5, 90))) for _ in range(60)]
    for t in texts[:60]:
        u = list(t)
        for _ in range(rng.randrange(len(t) // 3)):
            u[rng.randrange(len(u))] = rng.choice(["", "x", "yy"])
        texts.append("more " + "".join(u))
    x, y = np.arange(60), np.arange(60, 120)
    size = np.array([len(t) for t in texts])
    most = np.maximum(size[x], size[y]) // 5
    want = [edit.within(texts[i], texts[j], int(k)) for i, j, k in zip(x, y, most, strict=True)]
    calls = []
    monkeypatch.setattr(edit, "within", lambda a, b, k, of=edit.within: calls.append(a) or of(a, b, k))
    monkeypatch.setattr(edit, "_FEWEST", 2)
    assert edit.Texts(texts).within(x, y, most).tolist() == want and 20 <= sum(want) < 60
    assert len(calls) < 6
    whole = edit.Texts(texts)
    longer, shorter = np.where(size[x] < size[y], y, x), np.where(size[x] < size[y], x, y)
    got = whole._distances(longer, shorter, size[longer])
    for k, i, j in zip(got.tolist(), x, y, strict=True):
        assert edit.within(texts[i], texts[j], k) and not edit.within(texts[i], texts[j], k - 1)


def test_records_are_shuffled_in_packs(monkeypatch):
    """Buckets of two or more come out of packs whole, those in cells too, and no bucket of one does."""
    monkeypatch.setattr(linkage, "SLOT", 5000)
    rng = np.random.default_rng(1)
    key = rng.integers(-(2**62), 2**62, 3000)[rng.integers(0, 3000, 20000)]
    key[:4000], key[4000:4100] = 77, -5
    node = rng.integers(-(2**62), 2**62, 900)[rng.integers(0, 900, 20000)]
    hot = {77: 4, -5: 300}
    batches = [pa.record_batch([pa.array(key[i : i + 700]), pa.array(node[i : i + 700])], names=["key", "node"]) for i in range(0, 20000, 700)]
    packs = pa.Table.from_batches(linkage._packs(iter(batches), hot, 24))
    assert len(packs) < 1000 and sum(map(len, packs.column("data").to_pylist())) <= 12 * 20000
    rows = packs.sort_by([("slot", "ascending"), ("key", "ascending"), ("cell", "ascending")]).to_batches(max_chunksize=7)
    want, plain, cells = defaultdict(set), defaultdict(dict), defaultdict(dict)
    for k, n in zip(key.tolist(), node.tolist(), strict=True):
        want[k].add(n)
    for k, c, n, hub in pa.Table.from_batches(linkage._unpacked(iter(rows))).to_pandas().itertuples(index=False):
        (plain[k] if c < 0 else cells[k, c])[n] = hub
    assert sorted(map(sorted, plain.values())) == sorted(sorted(v) for k, v in want.items() if k not in hot and len(v) > 1)
    assert all({n for (a, _), v in cells.items() if a == k for n in v} == want[k] for k in hot)
    assert all(set(v.values()) == {min(v)} for v in [*plain.values(), *cells.values()])
