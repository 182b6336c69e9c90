"""Licence scans by sentence-rule recognition (operator 3).

A text becomes its words in lower case with a mark wherever a line or a sentence
ends between two of them.  Known licence sentences are looked up from mark to
mark, in text order; marks inside one (wrapped lines, abbreviations such as
``v. 2.0``) do not count.  The identifiers found are matched against licence
rules, each an ordered sequence of identifiers that may have others between.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Well-known licence sentences, normalised (lower case, words of letters and digits, single spaces).
SENTENCES = {
    "apache2-ref": "licensed under the apache license version 2 0",
    "apache2-ref-the": "licensed under the apache license version 2 0 the license",
    "apache2-comply": "you may not use this file except in compliance with the license",
    "apache2-copy": "you may obtain a copy of the license at",
    "apache2-unless": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache2-title": "apache license version 2 0 january 2004",
    "apache2-terms": "terms and conditions for use reproduction and distribution",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "boost-title": "boost software license version 1 0 august 17th 2003",
    "boost-grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "mit-ref": "released under the mit license",
    "mit-ref-licensed": "licensed under the mit license",
    "mit-ref-this": "this project is licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "mit-as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-as-is": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "bsd-as-is": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-ref": "licensed under the bsd license",
    "gpl3-ref": "this work is licensed under the gnu general public license version 3",
    "gpl3-ref-short": "licensed under the gnu general public license version 3",
    "gpl-redistribute": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-redistribute": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "lgpl21-redistribute": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl3-redistribute": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl3-redistribute": "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-only-redistribute": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 2 of the license",
    "gpl2-only-short": "you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
    "gpl3-only-redistribute": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 3 of the license",
    "gpl2-ref": "licensed under the gnu general public license version 2",
    "lgpl3-ref": "licensed under the gnu lesser general public license version 3",
    "agpl3-ref": "licensed under the gnu affero general public license version 3",
    "mpl2-ref": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "cc-by-ref": "licensed under cc by 4 0",
    "cc-by-sa-ref": "licensed under cc by sa 4 0",
    "cc-by-nc-ref": "licensed under cc by nc 4 0",
    "cc-by-nd-ref": "licensed under cc by nd 4 0",
    "cc0-ref": "licensed under cc0 1 0",
    "all-rights": "copyright all rights reserved",
    "unlicense-dedicate": "this is free and unencumbered software released into the public domain",
}

# Licence of every public identifier that a tag may name.
SPDX = {
    "AGPL-3.0-only": "AGPL-3.0", "AGPL-3.0-or-later": "AGPL-3.0", "Apache-2.0": "Apache-2.0", "BSD-2-Clause": "BSD-2-Clause", "BSD-3-Clause": "BSD-3-Clause",
    "CC-BY-4.0": "CC-BY-4.0", "CC-BY-NC-4.0": "CC-BY-NC-4.0", "CC-BY-ND-4.0": "CC-BY-ND-4.0", "CC-BY-SA-4.0": "CC-BY-SA-4.0", "CC0-1.0": "CC0-1.0",
    "GPL-2.0-only": "GPL-2.0", "GPL-2.0-or-later": "GPL-2.0", "GPL-3.0-only": "GPL-3.0", "GPL-3.0-or-later": "GPL-3.0", "ISC": "ISC",
    "LGPL-2.1-only": "LGPL-2.1", "LGPL-2.1-or-later": "LGPL-2.1", "LGPL-3.0-only": "LGPL-3.0", "LGPL-3.0-or-later": "LGPL-3.0", "MIT": "MIT", "MPL-2.0": "MPL-2.0", "Unlicense": "Unlicense", "Zlib": "Zlib", "BSL-1.0": "BSL-1.0",
}
SENTENCES |= {f"spdx-{tag.lower()}": "spdx license identifier " + tag.lower().replace("-", " ").replace(".", " ") for tag in SPDX}

# Licence, and the sentence identifiers that must follow one another in this order.
RULES = [
    ("Apache-2.0", ["apache2-ref"]),
    ("Apache-2.0", ["apache2-ref-the"]),
    ("Apache-2.0", ["apache2-comply", "apache2-copy", "apache2-unless"]),
    ("Apache-2.0", ["apache2-title", "apache2-terms"]),
    ("Zlib", ["zlib-grant"]),
    ("BSL-1.0", ["boost-title"]),
    ("BSL-1.0", ["boost-grant"]),
    ("MIT", ["mit-ref"]),
    ("MIT", ["mit-ref-licensed"]),
    ("MIT", ["mit-ref-this"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-as-is"]),
    ("ISC", ["isc-grant"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD", ["bsd-ref"]),
    ("GPL-3.0", ["gpl3-ref"]),
    ("GPL-3.0", ["gpl3-ref-short"]),
    ("GPL-3.0", ["gpl-redistribute"]),
    ("GPL-3.0", ["gpl3-only-redistribute"]),
    ("GPL-2.0", ["gpl2-only-redistribute"]),
    ("GPL-2.0", ["gpl2-only-short"]),
    ("GPL-2.0", ["gpl2-ref"]),
    ("GPL-2.0", ["gpl2-redistribute"]),
    ("LGPL-2.1", ["lgpl21-redistribute"]),
    ("LGPL-3.0", ["lgpl3-redistribute"]),
    ("AGPL-3.0", ["agpl3-redistribute"]),
    ("Unlicense", ["unlicense-dedicate"]),
    ("LGPL-3.0", ["lgpl3-ref"]),
    ("AGPL-3.0", ["agpl3-ref"]),
    ("MPL-2.0", ["mpl2-ref"]),
    ("CC-BY-4.0", ["cc-by-ref"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-ref"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-ref"]),
    ("CC-BY-ND-4.0", ["cc-by-nd-ref"]),
    ("CC0-1.0", ["cc0-ref"]),
    ("Proprietary", ["all-rights"]),
]
RULES += [(name, [f"spdx-{tag.lower()}"]) for tag, name in SPDX.items()]

#: Of two licences whose rules begin alike, the one whose rule goes on wins: the first stands only if its last sentence occurs more often than the sentence that the second adds.
EXTENDED = [("BSD-2-Clause", "bsd-binary", "BSD-3-Clause", "bsd-endorse")]

# A holder's name in the clause on endorsement (1 to 12 words) gives way to the words of the known sentence.
_GAP = r"[^\p{L}\p{N}]+"
HOLDER = rf"\bneither{_GAP}the{_GAP}names?{_GAP}of{_GAP}(?:[\p{{L}}\p{{N}}]+{_GAP}){{1,12}}?nor{_GAP}the{_GAP}names{_GAP}of{_GAP}(?:its|their){_GAP}contributors"
HOLDER_PLAIN = "neither the name of the copyright holder nor the names of its contributors"
#: An expression of tags, up to the end of its line; its words but for OR, AND and WITH are tags or exceptions.
EXPRESSION = r"spdx-license-identifier:[ \t]*([^\r\n]*)"

#: Every known sentence holds one of these words whole, however it is wrapped or spelled in capitals, so texts without any need no cutting.
ANCHORS = ("license", "licensed", "copyright", "permission", "redistribution", "redistributions", "redistribute", "software", "terms", "cc", "cc0")
_MARK = "\x01"


def _marked(text: Column) -> Column:
    """Lower-case words with one blank between, or one mark where a line or a sentence ends; a mark at either end."""
    plain = F.regexp_replace(F.translate(F.lower(text), _MARK, " "), HOLDER, HOLDER_PLAIN)
    ends = F.regexp_replace(plain, r"[.!?;:](?=\s|$)|\R", _MARK)
    words = F.regexp_replace(F.concat(F.lit(_MARK), ends, F.lit(_MARK)), rf"[^\p{{L}}\p{{N}}{_MARK}]++", " ")
    return F.regexp_replace(words, rf" ?{_MARK}[ {_MARK}]*+", _MARK)


def _sentence_pattern() -> str:
    """All known sentences, longest first, from mark to mark."""
    every = sorted(SENTENCES.values(), key=lambda s: (-len(s), s))
    return f"(?<={_MARK})(?:{'|'.join(s.replace(' ', f'[ {_MARK}]') for s in every)})(?={_MARK})"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licences stated in every whole text.

    Returns ``id, n_sentences long`` (known sentences), ``sentence_ids string``
    (comma-joined, in text order, as often as they stand), ``licenses string``
    (distinct, sorted, comma-joined), one row per input row.  A line ends at a
    line break, a sentence at ``. ! ? ; :`` before white space or the end.  A known
    sentence counts where it begins and ends at such an end, the longest one
    where several begin, and the next is looked for behind it.  A holder's name
    in the BSD clause on endorsement may be any; BSD-2-Clause beside
    BSD-3-Clause needs a notice of its own.  Every tag of an
    ``SPDX-License-Identifier`` expression (OR, AND, WITH, brackets) counts.  Null or empty
    text states none.  A null id stays null, repeated rows stay repeated, other
    columns are not read.  A narrow map in built-in functions, linear in the text.
    """
    known = F.create_map(*[F.lit(x) for name, words in SENTENCES.items() for x in (words, name)])
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    some = F.col("text").rlike(rf"(?iu)(?<![\p{{L}}\p{{N}}])(?:{'|'.join(ANCHORS)})(?![\p{{L}}\p{{N}}])")
    hits = F.regexp_extract_all(_marked(F.col("text")), F.lit(_sentence_pattern()), F.lit(0))
    found = F.transform(hits, lambda h: F.try_element_at(known, F.translate(h, _MARK, " ")))
    rows = rows.withColumn("found", F.when(some, found).otherwise(F.expr("cast(array() AS array<string>)")))
    rows = rows.withColumn("sequence", F.concat(F.lit(","), F.array_join("found", ","), F.lit(",")))
    named = [F.when(F.col("sequence").rlike("," + "(?:[^,]+,)*?".join(f"{s}," for s in rule)), F.lit(name)) for name, rule in RULES]
    tags = F.create_map(*[F.lit(x) for tag, name in SPDX.items() for x in (tag.lower(), name)])
    lines = F.regexp_extract_all(F.lower("text"), F.lit(EXPRESSION), F.lit(1))
    words = F.flatten(F.transform(lines, lambda line: F.split(line, "[^a-z0-9.+-]+")))
    expressed = F.when(F.col("text").rlike("(?i)spdx-license-identifier:"), F.array_compact(F.transform(words, lambda w: F.try_element_at(tags, w)))).otherwise(F.expr("cast(array() AS array<string>)"))
    every = F.array_union(F.array_compact(F.array(*named)), expressed)
    times = lambda s: F.size(F.filter("found", lambda x: x == s))
    for plain, last, longer, added in EXTENDED:
        beaten = F.array_contains(every, longer) & ~F.array_contains(expressed, plain) & (times(last) <= times(added))
        every = F.when(beaten, F.array_remove(every, plain)).otherwise(every)
    rows = rows.withColumn("licenses", F.array_join(F.array_sort(every), ","))
    licenses = F.coalesce("licenses", F.lit(""))
    return rows.select(F.col("id").alias(id_col), F.size("found").cast("bigint").alias("n_sentences"), F.array_join("found", ",").alias("sentence_ids"), licenses.alias("licenses"))
