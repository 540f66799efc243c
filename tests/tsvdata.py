"""Hand-written quarterly TSV files for the ingest tests."""

from __future__ import annotations

import os

from factlake.schema import NUM_COLUMNS, PRE_COLUMNS, SUB_COLUMNS, TAG_COLUMNS


def sub_row(adsh, cik="100", name="Acme Corp", form="10-K", filed="20240215",
            period="20231231", **kw):
    base = {"adsh": adsh, "cik": cik, "name": name, "sic": "7372", "countryba": "US",
            "afs": "1-LAF", "wksi": "0", "fye": "1231", "form": form, "period": period,
            "fy": "2023", "fp": "FY", "filed": filed, "accepted": "2024-02-15 16:01:00.0",
            "prevrpt": "0", "detail": "1", "instance": f"{adsh}.xml", "nciks": "1"}
    base.update(kw)
    return base


def tag_row(tag, version="us-gaap/2023", custom="0", abstract="0", tlabel=None, **kw):
    base = {"tag": tag, "version": version, "custom": custom, "abstract": abstract,
            "datatype": "monetary", "iord": "D", "crdr": "C", "tlabel": tlabel or f"Label {tag}",
            "doc": "doc"}
    base.update(kw)
    return base


def num_row(adsh, tag="Revenues", version="us-gaap/2023", ddate="20231231", qtrs="4",
            uom="USD", value="100.5", segments="", coreg="", footnote=""):
    return {"adsh": adsh, "tag": tag, "version": version, "ddate": ddate, "qtrs": qtrs,
            "uom": uom, "segments": segments, "coreg": coreg, "value": value,
            "footnote": footnote}


def pre_row(adsh, report="1", line="1", tag="Revenues", version="us-gaap/2023", **kw):
    base = {"adsh": adsh, "report": report, "line": line, "stmt": "IS", "inpth": "0",
            "rfile": "H", "tag": tag, "version": version, "plabel": "Revenue", "negating": "0"}
    base.update(kw)
    return base


COLUMNS = {"sub": SUB_COLUMNS, "tag": TAG_COLUMNS, "num": NUM_COLUMNS, "pre": PRE_COLUMNS}


def write_table(raw_dir, quarter, table, rows, columns=None, extra_lines=(), raw_bytes=None):
    columns = columns or COLUMNS[table]
    d = os.path.join(raw_dir, quarter)
    os.makedirs(d, exist_ok=True)
    path = os.path.join(d, f"{table}.txt")
    if raw_bytes is not None:
        with open(path, "wb") as f:
            f.write(raw_bytes)
        return path
    lines = ["\t".join(columns)]
    for r in rows:
        lines.append("\t".join(str(r.get(c, "")) for c in columns))
    lines.extend(extra_lines)
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")
    return path


def write_quarter(raw_dir, quarter, sub, tag, num, pre, skip=()):
    for table, rows in (("sub", sub), ("tag", tag), ("num", num), ("pre", pre)):
        if table not in skip:
            write_table(raw_dir, quarter, table, rows)
