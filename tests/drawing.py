"""Small drawings for tests."""

STYLE = [1, 0, 0.5, 9, 0]
OLD_STYLE = [1, 2, 3, 1, 7]


def rec(*fields):
    return "\n".join(map(str, fields)) + "\n|~\n"


def section(number, *records):
    return f"#~{number}\n" + "".join(records)


def head(version="2.10", name="demo"):
    lines = [""] * 45
    lines[0], lines[11], lines[12] = name, version, "2D"
    lines[13:17] = ["0", "10", "-1", "5"]
    lines[20:24] = ["A4", "1", "mm", "RAD"]
    lines[29:45] = ["1" if i % 5 == 0 else "0" for i in range(16)]
    return section(3, "\n".join(lines) + "\n")


def drawing(*sections, end="##~~\n"):
    return ("".join(sections) + end).encode()


def tex(key, *lines, start=STYLE, modern=True, matrix=(1, 0, 5, 0, 1, 7, 0, 0, 1)):
    fonts = ["font", "alt"] if modern else ["font"]
    body = [x for line in lines for x in (line, 0)]
    return ["TEX", key, *start, 1, *matrix, 0, 0, *fonts, 0, 0, 2, 4, 0, 1.5, 0, len(lines), *body]


def child(assembly, tx, ty, members=(), matrix=None):
    return [0, 0, 0, len(members), *members, assembly, *(matrix or (1, 0, tx, 0, 1, ty, 0, 0, 1))]


def asse(key, name, *children):
    body = [x for i, c in enumerate(children) for x in ([0, *c] if i else c)]
    return rec("ASSE", key, 0, name, 0, 0, 0, 0, 0, len(children), *body, *([0] if children else []))
