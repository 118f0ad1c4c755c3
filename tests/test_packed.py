import pytest

from quire.operators.packed import cover, head, pieces, spans, split_packed
from quire.plans.data_queries import p1_author_entries

SCHEMA = "book_id int, authors_csv string, pdf_links string, pos int, item string"


def entries(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    got = split_packed(df, ["book_id"], ["authors_csv", "pdf_links"], **kw).collect()
    return sorted((r.book_id, r.field, r.pos, r.item) for r in got)


@pytest.mark.parametrize(
    ("value", "want"),
    [
        ("", []),
        ("  \t ", []),
        (",,;", []),
        ("12", ["12"]),
        (" 1, 2;3؛4،5|6/7&8\t9\n10 ", [str(i) for i in range(1, 11)]),
        ("1,1, ,1", ["1", "1", "1"]),
        ("[1, 2]", ["1", "2"]),
        (" [ '1' ] ", ["1"]),
        ('"a, b";c', ["a, b", "c"]),
        ('"say ""x"", y"', ['say "x", y']),
        ("«a؛ b»،“c, d”|'e;f'", ["a؛ b", "c, d", "e;f"]),
        ('"open, 2', ['"open', "2"]),
        ("O'Hara, x", ["O'Hara", "x"]),
        ("https://a.example/b?c=1&d=2, vol 1.pdf", ["https://a.example/b?c=1&d=2", "vol 1.pdf"]),
        ("المجلد ٢: https://a.example/7.pdf|x", ["المجلد ٢: https://a.example/7.pdf", "x"]),
        ("٣٤،5", ["٣٤", "5"]),
    ],
)
def test_cover_without_dictionary(value, want):
    assert cover(value, set()) == want


def test_long_field():
    n = 50_000
    assert cover(",".join(map(str, range(n))), set()) == [str(i) for i in range(n)]


def test_pieces_partition_the_field():
    v = "a,b;'c,d'|e"
    assert [v[a:b] for a, b, _ in pieces(v)] == ["a", "b", "'c,d'", "e"]


def test_spans_skip_self_evident_values():
    assert spans("1,2,3") == []
    assert "Smith, John" in spans("Smith, John; 3")


def test_known_value_keeps_its_separator(spark):
    rows = [(1, '"Smith, John";7', None, 0, "x"), (2, "3; Smith, John / 4", None, 0, "x")]
    assert entries(spark, rows) == [(1, "authors_csv", 1, "Smith, John"), (1, "authors_csv", 2, "7"), (2, "authors_csv", 1, "3"), (2, "authors_csv", 2, "Smith, John"), (2, "authors_csv", 3, "4")]


def test_given_dictionary(spark):
    names = spark.createDataFrame([("Doe, Jane",), (None,), ("plain",)], "name string")
    rows = [(1, "Doe, Jane,Doe,5", None, None, None)]
    assert entries(spark, rows, dictionary=names) == [(1, "authors_csv", 1, "Doe, Jane"), (1, "authors_csv", 2, "Doe"), (1, "authors_csv", 3, "5")]
    odd = spark.createDataFrame([("5;3a",)], "name string")
    assert entries(spark, [(1, "5;3a", None, 0, "")], dictionary=odd) == [(1, "authors_csv", 1, "5;3a")]


def test_known_value_of_any_number_of_pieces(spark):
    for n in (5, 40):
        whole = ", ".join(f"N{i}" for i in range(n))
        rows = [(1, f'"{whole}";7', None, 0, "x"), (2, f"3; {whole} / 4", None, 0, "x"), (3, f"{whole}, N", None, 0, "x")]
        want = [(1, "authors_csv", 1, whole), (1, "authors_csv", 2, "7"), (2, "authors_csv", 1, "3"), (2, "authors_csv", 2, whole), (2, "authors_csv", 3, "4"), (3, "authors_csv", 1, whole), (3, "authors_csv", 2, "N")]
        assert entries(spark, rows) == want


def test_links_and_known_values_compete():
    link = "x https://a.b/c&d, e; f"
    assert cover(link, set()) == ["x https://a.b/c&d", "e", "f"]
    assert cover(link, {(2, 20)}) == ["x https://a.b/c&d", "e", "f"]  # begins inside an entry
    assert cover(link, {(0, 20)}) == ["x https://a.b/c&d, e", "f"]
    assert cover("A, B, C, D", {(0, 4), (3, 7), (6, 10)}) == ["A, B", "C, D"]  # the cover, not the first match
    assert cover("A, B, C, D", {(0, 4), (3, 10)}) == ["A", "B, C, D"]
    assert cover("'A, B', C", {(0, 9), (1, 9)}) == ["A, B", "C"]  # a quotation is one entry
    assert cover("https://a/b https://c/d,x", set()) == ["https://a/b https://c/d", "x"]
    assert head("A, B; C") == "A, B" and head("A") is None and head("1, 2") is None and head("https://a/b, C, D") == "https://a/b, C" and head("'A, b', C") is None
    assert spans("1; 2, N") == ["1; 2", "2, N"] and head("1; 2, N") == "1; 2"


def test_rows_that_only_the_dictionary_gets_right(spark):
    """Of values with five pieces and more the quotation marks alone explain one field in three."""
    wholes = [", ".join(f"{w}{i}" for i in range(n)) for w, n in (("A", 5), ("B", 6), ("C", 9))]
    rows = [(i, f'"{w}";7', None, 0, "x") for i, w in enumerate(wholes)]
    rows += [(10 + i, f"3; {w} / 4", None, 0, "x") for i, w in enumerate(wholes)] + [(20 + i, f"{w}/{wholes[0]}", None, 0, "x") for i, w in enumerate(wholes)]
    got = entries(spark, rows)
    want = [(i, 1, w) for i, w in enumerate(wholes)] + [(i, 2, "7") for i in range(3)]
    want += [(10 + i, p, x) for i, w in enumerate(wholes) for p, x in ((1, "3"), (2, w), (3, "4"))] + [(20 + i, p, x) for i, w in enumerate(wholes) for p, x in ((1, w), (2, wholes[0]))]
    assert got == sorted((b, "authors_csv", p, x) for b, p, x in want)
    alone = {(b, "authors_csv", p, x) for b, v, *_ in rows for p, x in enumerate(cover(v, set()), 1)}
    assert len(set(got) - alone) == 12 and len(alone - set(got)) > 40


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, "1,2", None, 9, "y"), (1, "1,2", None, 8, "z"), (None, "3", "", None, None), (2, None, " ", None, None)]
    assert entries(spark, [r for r in rows if r[0] is not None]) == [(1, "authors_csv", 1, "1"), (1, "authors_csv", 2, "2")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert split_packed(df, ["book_id"], ["authors_csv"]).where("book_id is null").count() == 1


def test_empty_table(spark):
    assert entries(spark, []) == []


def test_author_ids_in_digits_of_any_script(spark, tmp_path):
    rows = [(1, "12; ١٢; ۱۲", None), (2, "۱۲, 34", None), (3, "１２|१२", None), (4, "𝟏𝟐; x1", None)]
    spark.createDataFrame(rows, "book_id int, authors_csv string, pdf_links string").write.parquet(f"{tmp_path}/book.parquet")
    spark.createDataFrame([("plain",)], "author_name string").write.parquet(f"{tmp_path}/author.parquet")
    assert sorted(map(tuple, p1_author_entries(spark, str(tmp_path)).collect())) == [(12, 4, 1), (34, 1, 2)]
