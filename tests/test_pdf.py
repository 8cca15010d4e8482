"""PDF files written in bytes here, read as tables."""

import base64
import zlib

import pytest

from pramana.sources import pdf, pdf_syntax, tables
from pramana.sources.pdf_syntax import File, Ref, decoded, rc4, shown_text, unicode_map, value_at
from pramana.sources.pdf_writer import MAPPED, NESTED, PACKED, PLAIN, PROTECTED, pdf_of

PAGES = ["Hello (world) \\ é\nline  two\n\nfour ", "", "third 99% €"]


def built(bodies, root=1, tail=b""):
    out = b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, b) for n, b in bodies.items())
    return out + b"trailer\n<< /Root %d 0 R >>\nstartxref\n0\n%%%%EOF\n" % root + tail


def stream(data, more=b""):
    return b"<< /Length %d %s >>\nstream\n%s\nendstream" % (len(data), more, data)


def texts(spark, files, **passwords):
    rows = [(name, content, passwords.get(name)) for name, content in files.items()]
    table = spark.createDataFrame(rows, "path string, content binary, password string").repartition(2)
    found = {}
    for r in pdf.page_texts(table, table["password"]).collect():
        found.setdefault(r["path"], {})[r["page"]] = r["text"]
    counts = {r["path"]: r["pages"] for r in pdf.page_counts(table, table["password"]).collect()}
    states = {r["path"]: r["s"] for r in table.select("path", pdf.file_state(table["content"], table["password"]).alias("s")).collect()}
    return {k: [t for _, t in sorted(v.items())] for k, v in found.items()}, counts, states


def test_values():
    assert value_at(b" << /A#20b [1 -2.5 (x\\)\\101\\\ny) <4 1>] /C 3 0 R /D true >> rest")[0] == {"A b": [1, -2.5, b"x)Ay", b"A"], "C": Ref(3), "D": "true"}
    assert value_at(b"% note\n(a(b)c)")[0] == b"a(b)c"
    assert rc4(b"Key", b"Plaintext").hex().upper() == "BBF316E8D940AF0AD3"
    with pytest.raises(ValueError):
        value_at(b"(no end")


def test_filters():
    data = bytes(range(200))
    up = b"".join(b"\x02" + bytes((b - (data[i * 20 + j - 20] if i else 0)) & 255 for j, b in enumerate(data[i * 20 : i * 20 + 20])) for i in range(10))
    assert decoded({"Filter": "FlateDecode", "DecodeParms": {"Predictor": 12, "Columns": 20}}, zlib.compress(up)) == data
    assert decoded({"Filter": ["ASCII85Decode", "FlateDecode"]}, base64.a85encode(zlib.compress(data)) + b"~>") == data
    assert decoded({"Filter": ["ASCIIHexDecode"]}, data.hex().encode() + b">") == data
    with pytest.raises(zlib.error):
        decoded({"Filter": "FlateDecode"}, b"damaged")


def test_text_operators():
    plain = {"F": ({i: chr(i) for i in range(256)}, 1)}
    assert shown_text(b"BT /F 9 Tf (a) Tj [(b) -300 (c) -20 (d)] TJ 0 -12 Td (e) Tj 5 0 Td (f) Tj (g) ' ET", plain) == "ab cd\ne f\ng"
    assert shown_text(b"/F 9 Tf 1 0 0 1 5 700 Tm (a) Tj 1 0 0 1 50 700 Tm (b) Tj 1 0 0 1 5 680 Tm (c) Tj BI /W 1 ID (no) Tj \n EI (d) Tj", plain) == "a b\ncd"
    codes, width = unicode_map(b"1 begincodespacerange <0000> <ffff> endcodespacerange 2 beginbfrange <0001> <0003> <0905> <0010> <0011> [<00660069> <0078>] endbfrange 1 beginbfchar <0020> <d83dde42> endbfchar")
    assert width == 2 and codes == {1: "अ", 2: "आ", 3: "इ", 16: "fi", 17: "x", 32: "🙂"}
    assert shown_text(b"/T 9 Tf <0001001000200003FFFF> Tj", {"T": (codes, width)}) == "अfi🙂इ�"


def test_files_of_every_style(spark):
    files = {style: pdf_of(PAGES, style) for style in (PLAIN, PACKED, MAPPED, NESTED, PROTECTED)}
    files |= {"right": pdf_of(PAGES, PROTECTED, "sésame"), "wrong": pdf_of(PAGES, PROTECTED, "other"), "asked": pdf_of(PAGES, PROTECTED, "other"), "none": pdf_of([], PLAIN), "indic": pdf_of(["நான்\nहिन्दी 🙂"], MAPPED)}
    found, counts, states = texts(spark, files, right="sésame", wrong="guess")
    want = [p.strip("\n") for p in PAGES]
    for style in (PLAIN, PACKED, MAPPED, NESTED, PROTECTED, "right"):
        assert found[style] == want and counts[style] == 3
    assert found["indic"] == ["நான்\nहिन्दी 🙂"]
    assert {"wrong", "asked", "none"}.isdisjoint(found) and counts["none"] == 0 and counts["wrong"] == counts["asked"] == 1
    assert [states[x] for x in (PLAIN, PROTECTED, "right", "wrong", "asked", "none")] == ["open", "opened", "opened", "password_wrong", "password_required", "open"]


def test_trees_fonts_and_updates(spark):
    page = b"<< /Type /Page /Parent 2 0 R /Contents %s %s >>"
    show = stream(b"BT /F1 9 Tf (A\\201b) Tj ET")
    font = b"/Resources << /Font << /F1 << /Type /Font /Subtype /Type1 /Encoding << /Type /Encoding /Differences [65 /uni0905 /eacute 129 /rupee] >> >> >> >>"
    tree = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R 7 0 R] /Count 9 %s >>" % font, 3: page % (b"4 0 R", b""), 4: show}
    tree[7] = b"<< /Type /Pages /Parent 2 0 R /Kids [8 0 R 2 0 R 7 0 R 9 0 R] >>"  # two ways back
    tree[8] = page % (b"[4 0 R 5 0 R]", b"/Resources 6 0 R")
    tree |= {5: stream(b"0 -9 Td (tail) Tj", b""), 6: b"<< /Font 10 0 R >>", 10: b"<< /F1 11 0 R >>", 11: b"<< /Type /Font /Subtype /Type1 >>", 9: b"<< /Type /Page /Parent 7 0 R >>"}
    newer = b"4 0 obj\n" + stream(b"BT /F1 9 Tf (BBB) Tj ET") + b"\nendobj\ntrailer\n<< /Prev 1 >>\nstartxref\n9\n%%EOF"
    damaged = tree | {5: stream(b"no flate", b"/Filter /FlateDecode")}
    aes = built(tree).replace(b"/Root 1 0 R", b"/Root 1 0 R /Encrypt << /Filter /Standard /V 5 /R 6 /P 1 /O <00> /U <00> >>")
    files = {"tree": built(tree), "newer": built(tree, tail=newer), "damaged": built(damaged), "aes": aes, "cut": built(tree)[:-40], "text": b"%PDF-1.4 nothing", "empty": b"", "rootless": built({1: b"<< /Type /Catalog >>"}), "null": None}
    found, counts, states = texts(spark, files)
    assert found["tree"] == ["अ₹b", "A\x81b\ntail".replace("\x81", "�"), ""] and counts["tree"] == 3
    assert found["newer"] == ["ééé", "BBB\ntail", ""]
    assert set(found) == {"tree", "newer"}
    assert {k: v for k, v in counts.items() if k not in ("tree", "newer")} == {"damaged": 3, "aes": 1, "cut": 1, "text": 1, "empty": 1, "rootless": 1, "null": 1}
    assert states["damaged"] == "open" and {states[x] for x in ("aes", "cut", "text", "empty", "rootless", "null")} == {"unreadable"}


def test_files_of_a_folder(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for name, content in {"one.pdf": pdf_of(["in a folder"]), "a/two.PDF": pdf_of(["deeper", "twice"], PACKED), "note.txt": b"no"}.items():
        (tmp_path / name).write_bytes(content)
    found = pdf.page_texts(tables.uploads(spark, str(tmp_path))).collect()
    assert sorted((r["path"].split("/")[-1], r["page"], r["text"]) for r in found) == [("one.pdf", 1, "in a folder"), ("two.PDF", 1, "deeper"), ("two.PDF", 2, "twice")]


def test_lengths_by_reference_and_wrong_ones():
    body = b"BT (x) Tj ET"
    for length in (b"9 0 R", b"99999", b"1"):
        data = built({1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Kids [] >>", 4: b"<< /Length %s >>\nstream\n%s\nendstream" % (length, body), 9: b"%d" % len(body)})
        assert File(data).stream(4).strip() == body


def test_a_tree_without_its_streams():
    content = pdf_of(["one", "two"], PROTECTED, "secret")
    kinds = lambda whole: sorted(r["kind"] for r in pdf._rows("a", content, "secret", whole))
    assert kinds(False) == ["Page", "Page", "Pages", "root"] and kinds(True) == ["Font", "Page", "Page", "Pages", "root", "stream", "stream"]


def test_keystreams_of_a_password_are_made_once():
    content = pdf_of(["one"], PROTECTED, "secret")
    pdf_syntax._short_keystream.cache_clear()
    assert pdf_syntax.File(content).state("wrong") == "password_wrong"
    before = pdf_syntax._short_keystream.cache_info()
    assert pdf_syntax.File(content).state("wrong") == "password_wrong"
    assert pdf_syntax._short_keystream.cache_info().misses == before.misses


def test_files_go_to_python_a_few_at_a_time(spark):
    from pramana.plans import pdf_queries

    pdf_queries.files(spark, "/root/testdata/sf0.001")
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 4 << 20


@pytest.mark.parametrize("read", [pdf.page_texts, pdf.page_counts])
def test_no_table_of_a_files_parts_goes_through_the_driver(spark, monkeypatch, read):
    plans, written = [], pdf.written
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(pdf, "written", lambda df, label: (plans.append(plan(df)), written(df, label))[1])
    table = spark.createDataFrame([("a", pdf_of(PAGES, NESTED)), ("b", pdf_of(PAGES, PLAIN))], "path string, content binary")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        found = read(table)
        assert found.count() == (2 if read is pdf.page_counts else 6)
        plans.append(plan(found))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert len(plans) > 3 and not [p for p in plans if "Broadcast" in p]
