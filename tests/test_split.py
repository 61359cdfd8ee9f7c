"""Files read in byte ranges give the nodes of files read whole."""

from kinforge.sources import charsets, ged, split

BODY = "".join(f"0 @I{i}@ INDI\n1 NAME Žiga{i} /Čuček/\n1 NOTE Über {i} šolska\n2 CONC pot\n2 CONT in več\n" for i in range(60))


def test_ranges_of_files_in_many_sets(spark, tmp_path):
    head = lambda name: f"0 HEAD\n1 CHAR {name}\n"
    files = {
        "utf8.ged": (head("UTF-8") + BODY).encode(), "bom.GED": b"\xef\xbb\xbf" + (head("UTF-8") + BODY).encode(), "silent1250.ged": ("0 HEAD\n" + BODY).encode("cp1250"), "lies.ged": (head("UTF-8") + BODY).encode("cp1250"),
        "latin2.ged": (head("ISO-8859-2") + BODY).encode("iso8859-2"), "wide.ged": (head("UNICODE") + BODY).encode("utf-16"), "crlf.ged": (head("UTF-8") + BODY).replace("\n", "\r\n").encode(), "nul.ged": (head("UTF-8") + BODY).replace("pot", "p\0ot").encode(),
        "cut.ged": ("0 HEAD\n" + BODY).encode().replace("Č".encode() + b"u", b"\xc4\n2 CONC \x8cu", 1), "few bad+.ged": (head("UTF-8") + BODY).encode() + b"1 NOTE \xff\n", "cyrillic.ged": ("0 HEAD\n" + "1 NOTE Иванов Пётр Сергеевич\n" * 30).encode("cp1251"),
        "ansel.ged": (head("ANSEL") + "1 NOTE x\n" * 200).encode() + b"1 NAME \xe9Ziga /\xe9Cu\xe9cek/\n", "prefix.ged": (head("UTF-8") + "1 NOTE x\n").encode() + b"".join(b"1 NAME A" + bytes([b]) + b"a\n" for b in charsets.PREFIX_A if b > 0x7F) * 30, "one.ged": b"0 HEAD", "none.ged": b"",
    }
    for name, raw in files.items():
        (tmp_path / name).write_bytes(raw)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        lines = split.read_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 3
        got = {r["file"]: r["text"] for r in ged.serialize(ged.lines_to_nodes(lines)).collect()}
        want = {r["file"]: r["text"] for r in ged.serialize(ged.text_to_nodes(ged.read_files(spark, str(tmp_path)))).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want.pop("none.ged", None)
    got.pop("none.ged", None)
    assert got.keys() == want.keys()
    for name in want:
        assert got[name] == want[name], name
