"""Catalogs are read entry by entry."""

from __future__ import annotations

from glossaloom.sources import catalogs as C

PO = 'msgid ""\nmsgstr "head"\n\n# note\nmsgctxt "c"\nmsgid "a"\n"b"\nmsgstr "x"\nmsgid "d"\nmsgstr "y"\n\n\nmsgid "e \\n\\n f"\nmsgid_plural "es"\nmsgstr[0] "p"\nmsgstr[1] "q"\n'


def test_entries_are_rows(spark, tmp_path):
    (tmp_path / "my +dom-de.po").write_text(PO, encoding="utf-8")
    (tmp_path / "win-fr.po").write_bytes(PO.replace("\n", "\r\n").encode())
    rows = C.read_catalogs(spark, str(tmp_path)).collect()
    for domain, locale in (("my +dom", "de"), ("win", "fr")):
        got = sorted((r.msgctxt or "", r.msgid, r.form if r.form is not None else -1, r.msgstr) for r in rows if (r.domain, r.locale) == (domain, locale))
        assert got == [("", "d", -1, "y"), ("", "e \n\n f", 0, "p"), ("", "e \n\n f", 1, "q"), ("c", "ab", -1, "x")]
    own = C._entries(spark, str(tmp_path), "my*.po")
    assert own.count() > 2 and max(len(r.content) for r in own.collect()) < len(PO) / 2
