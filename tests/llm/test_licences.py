import itertools
import math
import os
import re
import textwrap
from collections import Counter, defaultdict

import pytest

from wordwood.llm import licences
from wordwood.llm.licences import LEAST_COSINE, STATEMENT, TEMPLATES

FILES = "doc_id long, path string, text string, is_licence boolean, unit string, licence string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], FILES).repartition(3)


def terms(text):
    return Counter(re.findall("[a-z0-9]+", text.lower()))


def plain(rows):
    def says(x):
        return re.search(STATEMENT.replace("(?i)", ""), x, re.I)

    def header(t):
        return "\n".join(itertools.takewhile(str.strip, t.lstrip().split("\n")))

    units = []
    for _, _, t, is_licence in rows:
        t, own = t or "", {}
        for kind, found in ((2, t.split("\n")), (1, [header(t)]), (0, [t] if is_licence else [])):
            own |= {x: kind for x in found if says(x)}
        units.append(own)
    n = sum(map(len, units))
    df = Counter(term for own in units for x in own for term in terms(x))
    known = {term for _, s in TEMPLATES for term in terms(s)}
    idf = lambda t: math.log((1 + n) / (1 + (df[t] if t in known else 0))) + 1

    def best(unit, kind):
        u = {t: c * idf(t) for t, c in terms(unit).items()}
        found = []
        for name, s in TEMPLATES:
            v = {t: c * idf(t) for t, c in terms(s).items()}
            dot = sum(u.get(t, 0) * x for t, x in v.items())
            norm = math.hypot(*u.values()) * math.hypot(*v.values())
            if norm and round(dot / norm, 6) >= LEAST_COSINE:
                found.append((kind, -round(dot / norm, 6), name))
        return min(found, default=None)

    own = [min(filter(None, (best(*x) for x in own.items())), default=None) for own in units]
    by_key = defaultdict(list)
    for (i, p, _, _), o in zip(rows, own, strict=True):
        if o:
            by_key[i, p].append(o)
    up = lambda p: p.rsplit("/", 1)[0] if "/" in p else ""
    above = defaultdict(list)
    for (_, p, _, is_licence), o in zip(rows, own, strict=True):
        if is_licence and p is not None and o:
            above[up(p)].append(o)
    out = []
    for i, p, _, _ in rows:
        o = min(by_key[i, p], default=None)
        name, where = (o[2] if o else None), None
        d = None if p is None else up(p)
        while not o and d is not None:
            if d in above:
                name, where = min(above[d])[2], d
                break
            d = up(d) if d else None
        out.append((i, p, o and o[2], o and -o[1], name, where))
    return out


MIT, APACHE = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
ROWS = [
    (1, "LICENSE", MIT, True),
    (2, "a/x.txt", "Text.\nMore text.", False),
    (3, "a/b/LICENSE", f"{APACHE}\nand so on", True),
    (4, "a/b/c/d/y.txt", "Text, text.", False),
    (5, "a/b/c/z.txt", f"Head\nThis work is licensed under the GNU General Public License, version 3.\n{MIT}", None),
    (6, "a/bb/w.txt", "Nothing here.", False),
    (7, "a/b/c/none", "Our licence to kill, as it were, in a long sentence without any template.", False),
    (8, None, MIT, True),
    (None, None, None, None),
    (9, "a/b/v.txt", "", False),
    (10, "q/LICENSE", "Licensed under CC BY-NC 4.0.", True),
    (11, "q/COPYING", "Licensed under CC BY 4.0.", True),
    (12, "q/r", "x", False),
    (12, "q/r", "x", False),
    (13, "", "empty path", False),
]


@pytest.mark.parametrize("more", [0, 40])
def test_against_plain(spark, more):
    rows = ROWS + [(100 + i, f"m/{i % 7}/{i}", [MIT, APACHE, "t"][i % 3], i % 5 == 0) for i in range(more)]
    got = licences.scan(frame(spark, rows)).collect()
    assert Counter(map(tuple, got)) == Counter(plain(rows))


def test_nearest_directory_wins(spark):
    got = {r.doc_id: (r.licence, r.inherited_from) for r in licences.scan(frame(spark, ROWS)).collect()}
    assert got[2] == ("MIT", "") and got[4] == ("Apache-2.0", "a/b")
    assert got[6] == ("MIT", "") and got[9] == ("Apache-2.0", "a/b")
    assert got[5][1] is None and got[8] == ("MIT", None)


def test_empty_table_and_own_templates(spark):
    df = frame(spark, ROWS)
    assert licences.scan(df.limit(0)).collect() == []
    got = licences.scan(df, templates=[("mine", MIT)]).collect()
    assert {r.own_licence for r in got} == {"mine", None}


def wrapped(text, width, mark):
    return "\n".join(mark + line for line in textwrap.wrap(text, width))


def test_notices_of_several_lines_and_tags(spark):
    mit = licences.MIT_GRANT + licences.MIT_REST
    gnu = {name: licences._gnu_notice(*rest) for name, *rest in licences.GNU}
    code = "\n\nint main() {\n    return the_answer_to_all_questions(42);\n}\n" * 9
    owner = "Copyright (c) 2021 Jane Doe and others"
    apache = wrapped(licences.APACHE_NOTICE, 70, "")
    texts = {
        1: ("MIT", f"MIT\n\n{owner}\n\n{wrapped(mit, 70, '')}\n", True),
        2: ("MIT", f"# {owner}\n#\n{wrapped(mit, 70, '# ')}{code}", False),
        3: ("Apache-2.0", f"/*\n{owner}\n\n{apache}\n*/{code}", False),
        4: ("Apache-2.0", f"#!/bin/sh\n# {owner}\n{wrapped(licences.APACHE_NOTICE, 60, '# ')}{code}", False),
        5: ("GPL-3.0", f"// {owner}\n{wrapped(gnu['GPL-3.0'], 70, '// ')}{code}", False),
        6: ("GPL-2.0", f"/* {owner}\n{wrapped(gnu['GPL-2.0'], 70, ' * ')}\n */{code}", None),
        7: ("AGPL-3.0", f"-- {owner}\n{wrapped(gnu['AGPL-3.0'], 70, '-- ')}{code}", False),
        8: ("MIT", f"// SPDX-License-Identifier: MIT{code}", False),
        9: ("Apache-2.0", f"# {owner}\n# SPDX-License-Identifier: Apache-2.0{code}", False),
        10: ("GPL-2.0", f"/* SPDX-License-Identifier: GPL-2.0-or-later */{code}", False),
        11: (None, f"// SPDX-License-Identifier: Unheard-Of-1.0{code}", False),
        12: ("MIT", f"{wrapped(licences.MIT_GRANT, 70, '')}{code}", False),
        13: (None, f"# {owner}\n# of this file{code}", False),
    }
    rows = [(i, f"d{i}/f", text, flag) for i, (_, text, flag) in texts.items()]
    got = {r.doc_id: r.own_licence for r in licences.scan(frame(spark, rows)).collect()}
    assert got == {i: name for i, (name, _, _) in texts.items()}


def test_a_whole_text_goes_before_its_lines(spark):
    bsd = f"Copyright (c) 2021 Jane Doe.\nAll rights reserved.\n\n{licences.BSD_GRANT + licences.BSD_NAMES + licences.BSD_REST}"
    rows = [(1, "a/LICENSE", bsd, True), (2, "a/x.c", "int x;", False)]
    got = {r.doc_id: (r.licence, r.inherited_from) for r in licences.scan(frame(spark, rows)).collect()}
    assert got == {1: ("BSD-3-Clause", None), 2: ("BSD-3-Clause", "a")}


SYSTEM = "/usr/share/common-licenses"
NAMES = ["Apache-2.0", "BSD", "CC0-1.0", "GFDL-1.3", "GPL-2", "GPL-3", "LGPL-2.1", "LGPL-3", "MPL-2.0"]


@pytest.mark.skipif(not os.path.isdir(SYSTEM), reason="no licence files on this system")
def test_whole_licence_files(spark):
    """Full texts as templates: each file is itself, also with a name in front and other line ends."""
    texts = licences.named_texts(spark, f"{SYSTEM}/{{{','.join(NAMES)}}}")
    assert [name for name, _ in texts] == NAMES
    rows = []
    for i, (name, text) in enumerate(texts):
        rows += [(i, f"{name}/LICENSE", f"Copyright (c) 2021 Jane Doe\n\n{text}", True)]
        rows += [(100 + i, f"{name}/deep/er/x.c", "int x;", False)]
    got = licences.scan(frame(spark, rows), templates=[*TEMPLATES, *texts]).collect()
    found = {r.doc_id: (r.licence, r.inherited_from) for r in got}
    same = {"BSD": ("BSD", "BSD-3-Clause"), "GPL-2": ("GPL-2", "GPL-2.0"), "GPL-3": ("GPL-3", "GPL-3.0")}
    for i, name in enumerate(NAMES):
        assert found[i][0] in same.get(name, (name,))
        assert found[100 + i] == (found[i][0], name)
