"""License scan with DataFrame functions alone: MinHash over overlapping windows, then exact containment.

Templates are grouped by size. For a group whose templates have at most c
shingles, windows of 1.5 c shingles start every c/2 shingles, so any occurrence
lies whole in some window and makes up a known part of it; enough minimum hashes
then collide with high probability. Collisions are verified by the share of the
template's shingles that the window holds.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, table

WORDS, CONTAINMENT = 5, 0.8
#: Minimum hashes of a window. The least part that a template's occurrence is of its window is about 0.8 * 0.5 / 1.5,
#: so one of 24 collides with probability 1 - (1 - 0.27)**24 = 0.9995.
HASHES = 24

# License statements and headers in common use.
TEMPLATES = {
    "Apache-2.0 (statement)": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT (statement)": "Released under the MIT License.",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "GPL-3.0 (statement)": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "CC-BY-4.0 (statement)": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0 (statement)": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0 (statement)": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "BSD (conditions)": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}


def _shingled(df: DataFrame, text: str) -> DataFrame:
    """df with `sh`: hashes of the text's shingles of WORDS words (a-z and 0-9), in order; a shorter text is one shingle, none has none."""
    df = df.withColumn("w", F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")))
    many = f"regexp_extract_all(w, '(?<![^ ])(?=((?:[^ ]+ ){{{WORDS - 1}}}[^ ]+))', 1)"
    few = "if(w = '', array(), array(w))"
    return df.withColumn("sh", F.expr(f"transform(if(w rlike '^(?:[^ ]+ ){{{WORDS - 1}}}', {many}, {few}), x -> xxhash64(x))")).drop("w")


def _class_of(n: int) -> int:
    return 1 << max(0, (n - 1).bit_length())


def _signature(sh: str) -> str:
    """SQL for HASHES minimum hashes of an array of hashes, as keys that differ by their place."""
    return "array(" + ", ".join(f"xxhash64({k}, array_min(transform({sh}, x -> xxhash64(x, {k}))))" for k in range(HASHES)) + ")"


def templates_df(spark: SparkSession, templates: dict[str, str]) -> tuple[DataFrame, list[int]]:
    """(license, class, t_sh, keys) of the templates, and the classes of sizes among them."""
    sizes = {name: max(1, len(re.findall(r"[a-z0-9]+", text.lower())) - WORDS + 1) for name, text in templates.items()}
    rows = [(name, _class_of(sizes[name]), text) for name, text in templates.items()]
    df = _shingled(spark.createDataFrame(rows, "license string, class int, text string"), "text").drop("text")
    return df.withColumn("keys", F.expr(_signature("sh"))).withColumn("t_sh", F.array_distinct("sh")).drop("sh"), sorted({r[1] for r in rows})


def license_matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, n_licenses, licenses (sorted, comma-joined), best (largest containment): one row per input row.

    A license is found if some window holds at least that share of its
    template's distinct shingles. Texts that share no shingle with any template
    cannot hold one and are not cut into windows. Null and empty texts have no
    license ('' and 0.0). Repeated rows and null ids are rows like others. An
    empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    t, classes = templates_df(spark, TEMPLATES if templates is None else templates)
    known = sorted({h for r in t.select("t_sh").collect() for h in r.t_sh})  # the templates are ours and few
    d = _shingled(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")), "text").drop("text")
    hit = F.arrays_overlap("sh", F.lit([int(h) for h in known]).cast("array<bigint>"))
    d = checkpointed(d.select("doc_id", F.when(hit, F.col("sh")).alias("sh")))
    none = d.where("sh is null").select("doc_id", F.lit(0).cast("bigint").alias("n_licenses"), F.lit("").alias("licenses"), F.lit(0.0).alias("best"))
    # a text goes by its id and the hash of its shingles from here on, so windows carry no text
    some = checkpointed(d.where("sh is not null").withColumn("mark", F.xxhash64("sh")).groupBy("doc_id", "mark").agg(F.first("sh").alias("sh"), F.count(F.lit(1)).alias("copies")))
    cut = lambda c: F.expr(f"explode_outer(transform(sequence(1, size(sh), {max(1, c // 2)}), i -> slice(sh, i, {c + max(1, c // 2)})))").alias("win")
    parts = [some.select("doc_id", "mark", F.lit(c).alias("class"), cut(c)) for c in classes]
    keyed = reduce(DataFrame.unionByName, parts).withColumn("keys", F.expr(_signature("win"))).select("doc_id", "mark", "class", "win", F.explode_outer("keys").alias("key"))
    met = keyed.join(F.broadcast(t.select("license", "class", "t_sh", F.explode("keys").alias("key"))), ["class", "key"])
    share = F.size(F.array_intersect("t_sh", "win")) / F.size("t_sh")
    found = met.groupBy("doc_id", "mark", "license").agg(F.max(share).alias("share")).where(F.col("share") >= containment)
    by_doc = found.groupBy("doc_id", "mark").agg(F.sort_array(F.collect_list("license")).alias("l"), F.max("share").alias("best"))
    out = some.alias("s").join(by_doc.alias("f"), F.col("s.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("s.mark") == F.col("f.mark")), "left")
    out = out.select(F.col("s.doc_id").alias("doc_id"), F.when(F.col("l").isNull(), 0).otherwise(F.size("l")).cast("bigint").alias("n_licenses"), F.coalesce(F.array_join("l", ","), F.lit("")).alias("licenses"), F.coalesce("best", F.lit(0.0)).alias("best"), F.explode(F.expr("sequence(1, s.copies)")).alias("copy"))
    return none.unionByName(out.select("doc_id", "n_licenses", "licenses", "best"))


def op7(spark, sf_dir: str) -> DataFrame:
    return license_matches(table(spark, sf_dir, "documents"))
