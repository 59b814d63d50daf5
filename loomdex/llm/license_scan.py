"""License scan: sparse TF-IDF cosine of licence files and of header lines to
templates, then inheritance from the nearest ancestor directory by path joins.

A licence file (by its name) is compared as a whole.  Of every file, a licence
file too, the lines that hold a licence marker are compared, each by itself and
all of a file together.  Inverse document frequencies come from all compared units of
the corpus and the templates.  A file takes the template of its nearest unit,
if the cosine reaches the threshold.  A licence file's template also holds for
its directory; files without one of their own take that of the nearest
directory above them that has one.  Only DataFrame operations are used.

Inheritance is worked out for each directory, not for each file, so that a
directory with a third of all files costs no more there than a small one.

Defined results: a null or empty text has no licence of its own; a file with
a null path inherits nothing; among several licence files of a directory the
greater score decides, then the smaller licence name; templates that tie go by
licence name; files are told apart by id, so repeated rows are scanned as one
and come out alike, and of rows with one id and different texts the greatest
text of each unit counts; an empty table gives no rows; texts are read whole;
other columns, whatever their names, play no part.

Templates are notices, full licence texts and SPDX identifiers.  An identifier
is a unit of one term, so it matches as a whole or not at all.  As licence texts
share much of their wording, a full text needs a greater cosine; it and an
identifier go before a notice, and "all rights reserved", which stands beside
many licences, comes last.
"""

from __future__ import annotations

import pkgutil
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, hot_join

#: Least cosine of a match.
THRESHOLD = 0.6
#: Least cosine of a match with a full licence text.
FULL_TEXT_THRESHOLD = 0.8
#: Names of licence files.
LICENSE_NAME = r"(?i)^(licen[sc]e|copying|notice|unlicense)([._-].*)?$"
#: What a header line must hold to be compared.
MARKER = r"(?i)licen[sc]e|copyright|rights reserved|spdx|public domain|free software|permission is hereby|redistribution and use|creative commons"
TOKEN = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
#: What lies between two paragraphs: lines without a letter or digit.
BLANK = r"\n(?:[^\p{L}\p{N}\n]*+\n)++"
#: Comments: lines one after the other that begin as one, or what is between two signs.
COMMENTS = [r"(?md)(?:^[ \t]*(?:#|//|--|;|%|\*|/\*|rem\b)[^\n]*+\n?)++", r"(?s)/\*.*?\*/|<!--.*?-->|\"{3}.*?\"{3}|'{3}.*?'{3}"]
#: An SPDX expression and its identifiers, in lower case.
SPDX_NAME = r"[a-z0-9]+(?:[.+-]+[a-z0-9]+)*"
SPDX = rf"spdx-license-identifier:[ \t(]*({SPDX_NAME}(?:[ \t()+]+(?:and|or|with)[ \t()]+{SPDX_NAME})*)"
#: Makes one term of an identifier.
SPDX_TERM = "spdx-license-identifier."

# Licence names and the statements or notices they are recognised by.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software."),
    ("BSD-3-Clause", "Released under the 3-Clause BSD License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License, CC BY 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License, CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related rights to the public domain. CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "All rights reserved."),
]


#: The full texts in the folder licenses.
FULL_TEXTS = [
    "Apache-2.0", "Artistic-1.0-Perl", "BSD-2-Clause", "BSD-3-Clause", "CC-BY-SA-4.0", "CC0-1.0", "GFDL-1.2", "GFDL-1.3", "GPL-1.0", "GPL-2.0",
    "GPL-3.0", "ISC", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-1.1", "MPL-2.0", "Unlicense",
]
#: Section 13 of AGPL-3.0.
REMOTE = "13. Remote Network Interaction; Use with the GNU General Public License. Notwithstanding any other provision of this License, if you modify the Program, your modified version must prominently offer all users interacting with it remotely through a computer network (if your version supports such interaction) an opportunity to receive the Corresponding Source of your version by providing access to the Corresponding Source from a network server at no charge, through some standard or customary means of facilitating copying of software."


def full_texts() -> dict[str, str]:
    """The full text of each licence.  Those of AGPL-3.0, CC-BY-4.0 and
    CC-BY-NC-4.0 are made of their nearest relatives' by what sets them apart, so
    that their files are not taken for those; they are not the words themselves."""
    texts = {n: " ".join(pkgutil.get_data(__package__, f"licenses/{n}.txt").decode().split()) for n in FULL_TEXTS}
    agpl = re.sub(r"13\. Use with the GNU Affero .*?combination as such\.", REMOTE, texts["GPL-3.0"])
    texts["AGPL-3.0"] = re.sub(r"(?i)GNU General", "GNU Affero General", agpl)
    by = re.sub(r"(?i) b\. ShareAlike\..*?Adapter's License You apply\. (?=Section 4)", " ", texts["CC-BY-SA-4.0"])
    by = re.sub(r" c\. BY-SA Compatible License.*?(?= d\.)", "", by)
    texts["CC-BY-4.0"] = re.sub(r"(?i)-ShareAlike| and ShareAlike|-SA\b", "", by)
    nc = re.sub(r"Attribution (?=4\.0)", "Attribution-NonCommercial ", texts["CC-BY-4.0"])
    nc = nc.replace("reproduce and Share the Licensed Material, in whole or in part", "reproduce and Share the Licensed Material, in whole or in part, for NonCommercial purposes only")
    nc = nc.replace("produce, reproduce, and Share Adapted Material", "produce, reproduce, and Share Adapted Material for NonCommercial purposes only")
    texts["CC-BY-NC-4.0"] = nc + " NonCommercial means not primarily intended for or directed towards commercial advantage or monetary compensation."
    return texts


def template_list() -> list[tuple[str, str, int, float]]:
    """(license, unit_text, place, least): place is the order in which matches
    of a file are taken, least the cosine of a match, if greater."""
    full = full_texts()
    rows = [(name, text, 2 if name == "Proprietary" else 1, 0.0) for name, text in TEMPLATES]
    rows += [(name, text, 0, FULL_TEXT_THRESHOLD) for name, text in full.items()]
    names = sorted({name for name, _ in TEMPLATES} - {"Proprietary"} | set(full))
    return rows + [(name, SPDX_TERM + name.lower(), 0, 0.0) for name in names]


def template_rows(spark) -> DataFrame:
    rows = [(i, *row) for i, row in enumerate(template_list())]
    return spark.createDataFrame(rows, "template int, license string, unit_text string, place int, least double").coalesce(1)


def terms_of(units: DataFrame) -> DataFrame:
    """(…, term, tf) for units with a text; other columns are kept."""
    keys = [c for c in units.columns if c != "unit_text"]
    words = F.regexp_extract_all(F.lower("unit_text"), F.lit(TOKEN), F.lit(0))
    return units.select(*keys, F.explode_outer(words).alias("term")).where("term is not null").groupBy(*keys, "term").agg(F.count("*").alias("tf"))


def spdx_units(text: str) -> Column:
    """One unit for each SPDX identifier, without `-only` or `-or-later`."""
    names = F.flatten(F.transform(F.regexp_extract_all(F.lower(text), F.lit(SPDX), F.lit(1)), lambda x: F.regexp_extract_all(x, F.lit(SPDX_NAME), F.lit(0))))
    names = F.array_except(names, F.array(*map(F.lit, ("and", "or", "with"))))
    return F.transform(names, lambda x: F.concat(F.lit(SPDX_TERM), F.regexp_replace(x, "-(only|or-later)$", "")))


def units_of(files: DataFrame) -> DataFrame:
    """(id, unit, unit_text): the text of a licence file, the marker lines of a
    file and the paragraphs with one, all together and each, its comments with
    one, and its SPDX identifiers."""
    named = F.coalesce(F.element_at(F.split("path", "/"), -1).rlike(LICENSE_NAME), F.lit(False))
    marked = lambda parts: F.filter(parts, lambda x: x.rlike(MARKER))
    both = lambda parts, sign: F.concat(F.array(F.array_join(parts, sign)), parts)
    held = files.where(F.col("text").isNotNull() & (named | F.col("text").rlike(MARKER)))
    whole = F.when(named, F.array("text")).otherwise(F.array().cast("array<string>"))
    lines = both(marked(F.split("text", "\n")), "\n")
    paragraphs = both(marked(F.split("text", BLANK)), "\n\n")
    comments = F.concat(*(F.regexp_extract_all("text", F.lit(c), F.lit(0)) for c in COMMENTS))
    parts = F.concat(whole, lines, paragraphs, marked(comments))
    units = F.concat(F.array_distinct(F.transform(parts, lambda x: F.btrim(x))), F.array_distinct(spdx_units("text")))
    return held.select("id", F.posexplode_outer(units).alias("unit", "unit_text")).groupBy("id", "unit").agg(F.max("unit_text").alias("unit_text"))


def best_templates(files: DataFrame, scratch: Scratch, threshold: float) -> DataFrame:
    """(id, license, score) of files with a match of their own."""
    rows = template_rows(files.sparkSession)
    templates = scratch.write(terms_of(rows), "templates")
    units = scratch.write(terms_of(units_of(files)), "terms")
    # The count of all units, and the documents of each term, units and templates together.
    total = units.select("id", "unit").distinct().count() + rows.count()
    found = units.groupBy("term").agg(F.count("*").alias("df"))
    found = found.unionByName(templates.groupBy("term").agg(F.count("*").alias("df")))
    idf = found.groupBy("term").agg(F.sum("df").alias("df"), (F.log((1.0 + total) / (1.0 + F.sum("df"))) + 1.0).alias("idf"))
    idf = scratch.write(idf, "idf")
    # The commonest terms are hot keys.
    weigh = lambda frame, key: hot_join(frame, idf, "term", "df", F.col(key)).withColumn("w", F.col("tf") * F.col("idf")).drop("tf", "idf", "df")
    weighed, known = weigh(units, "id"), weigh(templates, "template")
    norms = known.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("template_norm"))
    known = known.join(norms, "template").withColumnRenamed("w", "template_w")
    weighed = scratch.write(weighed, "weighed")
    unit_norms = weighed.groupBy("id", "unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    # A unit's terms come together before they meet the templates, many of which share a common term.
    # The templates are a constant of this module, so their terms may be broadcast.
    kind = ["template", "license", "place", "least", "template_norm"]
    dots = weighed.repartition("id", "unit").join(F.broadcast(known), "term").groupBy("id", "unit", *kind)
    dots = dots.agg(F.sum(F.col("w") * F.col("template_w")).alias("dot")).join(unit_norms, ["id", "unit"])
    score = F.round(F.col("dot") / (F.col("norm") * F.col("template_norm")), 6)
    scored = dots.select("id", "license", "place", "least", score.alias("score"))
    scored = scored.where(F.col("score") >= F.greatest(F.lit(threshold), F.col("least")))
    best = scored.groupBy("id").agg(F.min(F.struct("place", (-F.col("score")).alias("less"), "license")).alias("b"))
    return best.select("id", F.col("b.license").alias("license"), (-F.col("b.less")).alias("score"))


def directory(path: Column) -> Column:
    """A path without its last part; the empty string is the root."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def inherited(files: DataFrame, own: DataFrame) -> DataFrame:
    """(dir, from_dir, license, score) of directories with one of their own or from above."""
    named = F.element_at(F.split("path", "/"), -1).rlike(LICENSE_NAME)
    stated = files.where(F.col("path").isNotNull()).where(named).join(own, "id")
    stated = stated.groupBy(directory(F.col("path")).alias("from_dir")).agg(
        F.min(F.struct((-F.col("score")).alias("less"), "license")).alias("b")
    )
    dirs = files.where(F.col("path").isNotNull()).select(directory(F.col("path")).alias("dir")).distinct()
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    lines = dirs.select("dir", F.explode(F.array_distinct(above)).alias("from_dir"))
    near = lines.join(stated, "from_dir").groupBy("dir").agg(
        F.max(F.struct(F.length("from_dir").alias("depth"), "from_dir", "b")).alias("n")
    )
    return near.select("dir", "n.from_dir", F.col("n.b.license").alias("dir_license"), (-F.col("n.b.less")).alias("dir_score"))


def scan(files: DataFrame, scratch: Scratch, threshold: float = THRESHOLD) -> DataFrame:
    """(id, path, license, score, origin, from_dir) of each row of files (id,
    path, text).  origin is own or inherited, null where nothing was found."""
    own = scratch.write(best_templates(files, scratch, threshold), "own")
    paths = scratch.write(files.select("id", "path"), "paths")
    above = scratch.write(inherited(paths, own), "above")
    rows = paths.join(own, "id", "left").withColumn("dir", directory(F.col("path"))).join(above, "dir", "left")
    has = F.col("license").isNotNull()
    return rows.select(
        "id",
        "path",
        F.when(has, F.col("license")).otherwise(F.col("dir_license")).alias("license"),
        F.when(has, F.col("score")).otherwise(F.col("dir_score")).alias("score"),
        F.when(has, F.lit("own")).when(F.col("dir_license").isNotNull(), F.lit("inherited")).alias("origin"),
        F.when(~has, F.col("from_dir")).alias("from_dir"),
    )


def document_paths(docs: DataFrame) -> DataFrame:
    """(id, path, text) of the documents.  They have no paths; each source is
    taken as a tree of directories for thousands and hundreds of ids, in which
    round ids stand for the licence files of their directories."""
    n = F.col("doc_id")
    thousands = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.floor(n / 1000).cast("string"))
    hundreds = F.concat_ws("/", thousands, F.floor(n / 100).cast("string"))
    name = F.when(n % 100 == 0, F.concat_ws("/", thousands, F.concat(F.lit("LICENSE."), n.cast("string"))))
    name = name.when(n % 10 == 0, F.concat_ws("/", hundreds, F.concat(F.lit("LICENSE."), n.cast("string"))))
    path = name.otherwise(F.concat_ws("/", hundreds, F.concat(F.lit("text."), n.cast("string"))))
    return docs.select(n.alias("id"), F.when(n.isNotNull(), path).alias("path"), "text")
