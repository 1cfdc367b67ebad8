"""A minimal workbook writer for fixtures."""

import zipfile
from xml.sax.saxutils import escape

NS = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _ref(row: int, col: int) -> str:
    name = ""
    col += 1
    while col:
        col, rest = divmod(col - 1, 26)
        name = chr(65 + rest) + name
    return f"{name}{row + 1}"


def _cell(row, col, value, strings):
    at = _ref(row, col)
    if value is None:
        return ""
    if isinstance(value, bool):
        return f'<c r="{at}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, tuple):                       # ("date", serial number)
        return f'<c r="{at}" s="1"><v>{value[1]}</v></c>'
    if isinstance(value, (int, float)):
        return f'<c r="{at}"><v>{value}</v></c>'
    if value.startswith("inline:"):
        return f'<c r="{at}" t="inlineStr"><is><t>{escape(value[7:])}</t></is></c>'
    strings.append(value)
    return f'<c r="{at}" t="s"><v>{len(strings) - 1}</v></c>'


def write_xlsx(path, sheets: dict[str, list[list]]) -> None:
    strings: list[str] = []
    parts = {}
    for i, rows in enumerate(sheets.values(), 1):
        body = "".join(f'<row r="{r + 1}">' + "".join(_cell(r, c, v, strings) for c, v in enumerate(row))
                       + "</row>" for r, row in enumerate(rows))
        parts[f"xl/worksheets/sheet{i}.xml"] = f'<worksheet xmlns="{NS}"><sheetData>{body}</sheetData></worksheet>'
    names = "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1))
    parts["xl/workbook.xml"] = f'<workbook xmlns="{NS}" xmlns:r="{REL}"><sheets>{names}</sheets></workbook>'
    links = "".join(f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
    parts["xl/_rels/workbook.xml.rels"] = f"<Relationships>{links}</Relationships>"
    parts["xl/sharedStrings.xml"] = (f'<sst xmlns="{NS}">' + "".join(
        f"<si><t>{escape(s)}</t></si>" for s in strings) + "</sst>")
    parts["xl/styles.xml"] = (f'<styleSheet xmlns="{NS}"><cellXfs><xf numFmtId="0"/><xf numFmtId="22"/>'
                              "</cellXfs></styleSheet>")
    with zipfile.ZipFile(path, "w") as book:
        for name, text in parts.items():
            book.writestr(name, text)
