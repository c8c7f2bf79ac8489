"""Metadata of files whose objects lie in compressed object streams."""

import zlib

from folio.functions.pdf import object_text
from folio.operators.review import pdf_metadata


def packed(objects, n=2, compress=True, length=True):
    head = " ".join(f"{k + 10} 0" for k in range(len(objects))).encode()
    body = head + b"\n" + "\n".join(objects).encode("latin-1")
    body = zlib.compress(body) if compress else body
    return b"%d 0 obj\n<< /Type /ObjStm /N %d /First %d%s%s >>\nstream\n" % (n, len(objects), len(head) + 1, b" /Filter /FlateDecode" if compress else b"", b" /Length %d" % len(body) if length else b"") + body + b"\nendstream\nendobj\n"


PAGE = "<< /Type /Page /MediaBox [0 0 612.04 792] /Annots [<< /Subtype /Widget >>] >>"
INFO = "<< /Producer (maker 7) /Title (A title) >>"


def test_object_streams(spark):
    image = b"9 0 obj << /Length 30 >>\nstream\n/Type /Page /Type /Page /Encrypt\nendstream\nendobj\n"
    files = {
        "packed": b"%PDF-1.5\n" + image + packed([PAGE, PAGE, INFO, "<< /MarkInfo << /Marked true >> /AcroForm 4 0 R >>"]),
        "two": b"%PDF-1.7\n" + packed([PAGE, INFO]) + packed([PAGE, PAGE], 3, compress=False) + packed([PAGE], 4, length=False),
        "plain": b"%PDF-1.4\n1 0 obj " + PAGE.encode() + b" endobj 2 0 obj " + INFO.encode() + b" endobj",
        "broken": b"%PDF-1.5\n" + packed([PAGE]).replace(b"stream\nx", b"stream\n!!"),
        "other filter": b"%PDF-1.5\n" + packed([PAGE]).replace(b"/FlateDecode", b"/LZWDecode"),
        "encrypted": b"%PDF-1.6\n" + packed([PAGE]) + b"trailer << /Encrypt 5 0 R >>",
        "none": b"no PDF",
        "empty": b"",
    }
    df = spark.createDataFrame([(k, v) for k, v in files.items()] + [("null", None)], "path string, content binary")
    got = {r["path"]: r for r in pdf_metadata(df).collect()}
    assert (got["packed"]["page_count"], got["packed"]["producer"], got["packed"]["title"], got["packed"]["is_tagged"], got["packed"]["form_type"], got["packed"]["form_field_count"], got["packed"]["error"], got["packed"]["whole"]) == (2, "maker 7", "A title", True, 1, 2, None, True)
    assert [(d["w"], d["h"]) for d in got["packed"]["page_dimensions"]] == [(612.0, 792.0)] * 2
    assert got["two"]["page_count"] == 4 and got["plain"]["page_count"] == 1 and got["plain"]["producer"] == "maker 7"
    assert got["other filter"]["page_count"] == 0 and not got["other filter"]["whole"]
    assert got["encrypted"]["error"] == "Incorrect password error" and got["none"]["error"] == got["empty"]["error"] == "Data format error"


def test_broken_streams_do_not_crash():
    whole = b"%PDF-1.5\n" + packed([PAGE])
    for cut in range(0, len(whole), 7):
        object_text(whole[:cut])
    text, fine = object_text(whole.replace(whole[60:64], b"\xff\xff\xff\xff"))
    assert isinstance(text, str) and isinstance(fine, bool)
