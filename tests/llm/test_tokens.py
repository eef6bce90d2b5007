"""Sentence pieces against the library, texts cut in three, and hard negatives against brute force."""

import dataclasses
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinspan.llm import middle, negatives, pieces

from .conftest import rows_of, sha

pytestmark = pytest.mark.filterwarnings("ignore")
LETTERS = list("ab ▁é日\n\t👩<0x41>1 2.,́ﬁＡ㍿") + ["the ", "of ", " and"]
ODD = ["", " ", "  ", "a", " a", "a ", "▁a ▁ b", "\x00a\x00", "日本語 テキスト", "👩‍👩‍👧 x́", "<s></s><0x41><unk>", "\n\n\t x", " " * 40 + "q", "x" * 63 + "y" * 70, "▁ ▁", "x▁ ", "<P>", "a<M>b"]


def texts(n=200, seed=5):
    rnd = random.Random(seed)
    return ODD + ["".join(rnd.choice(LETTERS) for _ in range(rnd.randint(1, 200))) for _ in range(n)]


# ---- pieces


@pytest.fixture(scope="module")
def model():
    import public_tokenizers

    return pieces.read_model(public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def test_pieces_are_those_of_the_library_and_know_their_bytes(spark, model, library):
    given = texts()
    docs = rows_of(spark, [*given, None]).withColumn("ids", F.lit("own")).repartition(3)
    out = {r.doc_id: r for r in pieces.decode_pieces(pieces.encode_pieces(docs, model), model).collect()}
    assert len(out) == len(given) + 1 and set(out[0].asDict()) == {"doc_id", "lang", "source", "n_chars", "n_tokens", "ids", "begins", "ends", "decoded"}
    assert (out[len(given)].ids, out[len(given)].decoded) == ([2], "")
    for i, text in enumerate(given):
        ids = library.encode(text, add_eos=True)
        assert (out[i].ids, out[i].n_tokens, out[i].decoded) == (ids, len(ids), library.decode(ids)), text
        wanted = [(p.begin, p.end) for p in library.encode(text, return_type="proto").pieces]
        found = list(zip(out[i].begins, out[i].ends))
        assert [x for x, k in zip(found, ids) if model.kinds[k] != pieces.BYTE] == [x for x, k in [*zip(wanted, ids), (found[-1], 2)] if model.kinds[k] != pieces.BYTE]
        # spans follow one another and cover the text
        assert [b for b, _ in found[1:]] == [e for _, e in found[:-1]] and found[-1] == (len(text.encode()),) * 2


def test_long_words_are_merged_alike_by_the_heap(model, library):
    rnd, merger = random.Random(3), pieces.Merger(model)
    for _ in range(50):
        word = "".join(rnd.choice("abcdeth") for _ in range(rnd.randint(2, 60)))
        symbols, _ = merger.merge([word])
        plain = [model.pieces[x] for x in symbols]
        assert pieces.merged(word, model) == plain
    word = "".join(rnd.choice("abcdeth") for _ in range(200_000))
    ids, sizes, first = merger.ids(["a", "▁" + word, "b"])
    assert ids[1:-1].tolist() == library.encode(word) and sizes.sum() == len(word) + 5 and first.tolist() == [0, 1, len(ids) - 1, len(ids)]


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "identity"])
@pytest.mark.parametrize("collapse", [True, False])
def test_compiled_maps_normalise_like_the_library(model, rule, collapse):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    theirs = sentencepiece.SentencePieceNormalizer(rule_name=rule, remove_extra_whitespaces=collapse, add_dummy_prefix=True, escape_whitespaces=True)
    char_map = proto.ModelProto.FromString(theirs.serialized_model_proto()).normalizer_spec.precompiled_charsmap
    own = pieces.Normaliser(dataclasses.replace(model, char_map=char_map, collapse=collapse))
    for text in [*texts(), "ﬁ Ａ  x㍿ é", " ﾊﾞ x　 y ", "Ǻé é", "①②", "한글 ㅎㅏㄴ", "ÀÉ ß ẞ"]:
        wanted, places = theirs.normalize(text, with_offsets=True)
        found, source = own(np.frombuffer(text.encode(), np.uint8))
        # the library counts code points
        points = np.cumsum([0, *((c & 0xC0) != 0x80 for c in text.encode())])
        begins = [i for i, c in enumerate(found.encode()) if (c & 0xC0) != 0x80]
        assert (found, [int(points[source[i]]) for i in [*begins, len(found.encode())]]) == (wanted, list(places)), text


def test_bytes_that_make_no_character_and_unread_models(model):
    decode = pieces.Decoder(model).decode
    of = model.bytes_
    assert decode(np.array([of[0xE6], of[0x97], of[0xA5], of[0xE6], model.of["a"], of[0xFF]])) == "日�a�"
    assert decode(np.array([1, model.of["▁"], model.of["▁"], 2])) == " " and decode(np.zeros(0, int)) == ""
    with pytest.raises(ValueError):
        dataclasses.replace(model, kinds=[*model.kinds[:-1], pieces.USER_DEFINED])


def test_pieces_of_an_empty_table(spark, model):
    assert pieces.decode_pieces(pieces.encode_pieces(rows_of(spark, ["x"]).limit(0), model), model).count() == 0


# ---- fill in the middle


def plain_transform(text, id_, percent=90, spm=20):
    h = [int(sha(f"1:{id_}")[i : i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(text)
    if not n or any(m in text for m in middle.SENTINELS) or h[2] % 100 >= percent:
        return "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "<P>" + text[:a], "<M>" + text[a:b], "<S>" + text[b:]
    return ("spm", a, b - a, s + p + m) if h[3] % 100 < spm else ("psm", a, b - a, p + s + m)


def test_cuts_are_at_code_points_and_outputs_give_texts_back(spark):
    given = [*texts(), "é" * 5000, "a日👩" * 3000]
    docs = rows_of(spark, given).withColumn("__text", F.lit("own")).withColumn("form", F.lit("own")).repartition(3)
    out = middle.fill_in_middle(docs, stride=16).withColumn("back", middle.restored()).collect()
    assert len(out) == len(given) and {r["__text"] for r in out} == {"own"} and {"psm", "spm", "plain"} == {r.form for r in out}
    for r in out:
        assert (r.form, r.prefix_chars, r.middle_chars, r.output) == plain_transform(given[r.doc_id], r.doc_id)
        assert r.n == len(given[r.doc_id]) and r.back == r.text


def test_null_texts_null_ids_repeats_and_empty_tables(spark):
    rows = [(None, "some text"), (3, None), (5, "again and again"), (5, "again and again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted((r.doc_id or 0, r.form, r.n, r.output) for r in middle.fill_in_middle(docs, percent=100).collect())
    assert out[0][2:] == (9, plain_transform("some text", "", 100)[3]) and out[1] == (3, "plain", 0, "") and out[2] == out[3]
    assert middle.fill_in_middle(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        middle.fill_in_middle(docs, sentinels=("<P>", "<S<", "<M>"))


@pytest.mark.parametrize("stride", [1, 3, 7, 512])
def test_checkpoints_find_every_unit(stride, monkeypatch):
    monkeypatch.setattr(middle, "WINDOW", 10)  # windows end within characters
    text = "a日é👩b" * 9
    points = middle.Checkpoints(np.frombuffer(text.encode(), np.uint8), stride)
    assert points.n == len(text) and len(points.units) == -(-len(text) // stride)
    assert [points.byte_of(i) for i in range(len(text) + 1)] == [len(text[:i].encode()) for i in range(len(text) + 1)]


# ---- hard negatives


def plain_mining(rows, positives=5, negatives_=5):
    """``rows``: id, label, vector; every hundredth id is an anchor."""
    rows = sorted({(i, lab, tuple(v)) for i, lab, v in rows if None not in (i, lab, v) and None not in v})
    dot = lambda x, y: sum(a * b for a, b in zip(x, y))
    out = []
    for i, lab, v in rows:
        if i % 100:
            continue
        scored = sorted((-dot(v, w), j, m) for j, m, w in rows)
        for p, j, _ in [x for x in scored if x[2] == lab and x[1] != i][:positives]:
            near = [x for x in scored if x[2] != lab and -80 * p <= -100 * x[0] <= -100 * p][:negatives_]
            out += [(i, j, k + 1, n, -p, -s) for k, (s, n, _) in enumerate(near)]
    return sorted(out)


def mined(spark, rows, **options):
    frame = spark.createDataFrame(rows, "id long, label int, v array<long>").withColumn("key", F.lit("own"))
    out = negatives.mine_hard_negatives(frame, F.col("id") % 100 == 0, **options)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, out.collect()))


def test_blocks_and_chunks_find_what_brute_force_finds(spark):
    rnd = random.Random(8)
    # one label has most rows; many scores are equal; vectors are of several lengths
    rows = [(i, 0 if rnd.random() < 0.6 else rnd.randint(1, 4), [rnd.randint(-2, 3) for _ in range(rnd.choice((9, 9, 9, 4)))]) for i in range(0, 1200)]
    wanted = plain_mining(rows)
    assert len(wanted) > 100
    assert mined(spark, rows, anchor_rows=2, block_rows=100, chunk=4) == wanted
    assert mined(spark, rows[::-1]) == wanted


def test_odd_rows_take_no_part_or_count_once(spark):
    rows = [(0, 1, [3, 4]), (0, 1, [3, 4]), (0, 2, [1, 1]), (1, 1, [3, 3]), (1, 1, [3, 3]), (2, 2, [3, 3]), (3, 2, [3, 3]), (4, 2, [2, 4]), (5, 1, []), (7, 1, [-1, -1]), (100, 9, [1, 1]), (200, 1, [0, 0])]
    odd = [(None, 1, [1, 1]), (6, None, [3, 3]), (8, 1, None), (9, 1, [None, 3])]
    assert mined(spark, rows + odd, chunk=1) == plain_mining(rows + odd) != []
    assert mined(spark, [(100, 1, [1])]) == [] and mined(spark, []) == []


def test_large_products_are_exact():
    a = np.array([[1 << 40, 3], [-5, 7]], np.int64)
    b = np.array([[1 << 20, 1], [9, -2], [0, 1 << 50]], np.int64)
    assert negatives.product(a, b).tolist() == [[sum(int(x) * int(y) for x, y in zip(r, s)) for s in b] for r in a]


def test_components_become_integers_or_the_row_takes_no_part(spark):
    rows = [([0.5, -0.001],), ([float("nan")],), ([float("inf")],), ([None],), (None,), ([],)]
    out = spark.createDataFrame(rows, "embedding array<float>").select(negatives.quantised()).collect()
    assert [r[0] for r in out] == [[128, -1], None, None, None, None, []]
