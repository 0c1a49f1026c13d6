"""Canonical digests of full licence texts, kept in ``licenses/digests.txt``.

``licenses/`` holds the texts as published, several where editions differ (file name: licence
id, then a letter). Their variants differ in what the canonical form keeps: title, list marks,
appendix, and line ends, as a line that begins with "copyright" goes. A text with other words
(a named organisation in the third BSD clause, say) is not among them.

``python -m beliefmill.llm.license_texts`` writes the digests anew from the texts.
"""

from __future__ import annotations

import re
import textwrap
from importlib import resources

from pyspark.sql import DataFrame

FOLDER = resources.files("beliefmill.llm") / "licenses"
DIGESTS = FOLDER / "digests.txt"
#: Line widths at which a text is wrapped anew; 0 is one line a paragraph.
WIDTHS = [0, *range(64, 84), 90, 100, 120]
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"], "ISC": ["ISC License", "The ISC License"], "Zlib": ["zlib License", "The zlib License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", "Simplified BSD License", "BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", "New BSD License", "Modified BSD License", "BSD License"],
}
LIST_MARK = re.compile(r"(?m)^ *(\d\.|[*-]) +")
END = re.compile(r"(?m)^ *END OF TERMS AND CONDITIONS *\n")


def texts() -> list[tuple[str, str]]:
    """(licence id, text) of every text kept."""
    files = sorted((f for f in FOLDER.iterdir() if f.name != DIGESTS.name), key=lambda f: f.name)
    return [(re.sub(r"(\.[b-z])?\.txt$", "", f.name), f.read_text(encoding="utf-8")) for f in files]


def wrapped(text: str, width: int) -> str:
    paragraphs = [" ".join(p.split()) for p in re.split(r"\n\s*\n", text)]
    return "\n\n".join(textwrap.fill(p, width, break_long_words=False, break_on_hyphens=False) if width else p for p in paragraphs)


def variants(license: str, text: str) -> set[str]:
    out = {text}
    if m := END.search(text):
        out |= {text[: m.start()], text[: m.end()]}
    if license in TITLES:
        out = {re.sub(rf"^\s*({'|'.join(map(re.escape, TITLES[license]))})\s*\n", "", t) for t in out}
        out |= {LIST_MARK.sub("", t) for t in out}
        out |= {t.replace("COPYRIGHT HOLDER OR", "COPYRIGHT OWNER OR") for t in out}
        out |= {f"{title}\n\n{t}" for t in out for title in TITLES[license]}
    return out | {wrapped(t, w) for t in out for w in WIDTHS}


def rows() -> list[tuple[str, str]]:
    return [(license, v) for license, text in texts() for v in variants(license, text)]


def full_digests(spark) -> DataFrame:
    """digest, license of all variants of all texts."""
    kept = [line.split() for line in DIGESTS.read_text(encoding="utf-8").splitlines()]
    return spark.createDataFrame(kept, "digest string, license string")


def main() -> None:
    from pyspark.sql import SparkSession

    from beliefmill.llm.license_scan import known_digests

    found = known_digests(SparkSession.builder.master("local[4]").getOrCreate(), rows()).collect()
    with open(str(DIGESTS), "w", encoding="utf-8") as f:
        f.writelines(sorted(f"{r.digest} {r.license}\n" for r in found))


if __name__ == "__main__":
    main()
