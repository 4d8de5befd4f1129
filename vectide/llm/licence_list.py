"""The known list of the licence scan: whole texts, each with and without its title and closing appendix.

The long texts are files beside this module and are read by the driver alone.
"""

from __future__ import annotations

import re
from functools import lru_cache
from pathlib import Path

from vectide.llm.licences import KNOWN

#: Titles that stand above a text, or not.
TITLES = {
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD", "Zero-Clause BSD License"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)"],
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "Expat License"],
    "Unlicense": ["The Unlicense", "Unlicense"],
    "Zlib": ["zlib License", "The zlib License", "zlib/libpng license"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", "Simplified BSD License", "BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", "New BSD License", "Modified BSD License", "BSD License"],
}

#: Where the body of a text begins after its title, for those of the files that have one.
BODY = {
    "Apache-2.0": "TERMS AND CONDITIONS FOR USE",
    "GPL-1.0": "Preamble",
    "GPL-2.0": "Preamble",
    "GPL-3.0": "Preamble",
    "LGPL-2.0": "Preamble",
    "LGPL-2.1": "Preamble",
    "LGPL-3.0": "This version of the GNU",
    "GFDL-1.2": "0. PREAMBLE",
    "GFDL-1.3": "0. PREAMBLE",
    "MPL-1.1": "1. Definitions",
    "MPL-2.0": "1. Definitions",
    "CC0-1.0": "Statement of Purpose",
    "Artistic-1.0-Perl": "Preamble",
}

#: What may close a text or be left out.
CLOSING = re.compile(r"^[ \t]*(END OF TERMS AND CONDITIONS|(Appendix: )?How to Apply These Terms|APPENDIX: How to apply|ADDENDUM: How to use|Exhibit A - Source|EXHIBIT A -Mozilla|The End[ \t]*$)", re.M)

BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
{third}
THIS SOFTWARE IS PROVIDED BY THE {whose} AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE {who} OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
THIRD = "\n3. Neither the name of {name} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"


def _bsd() -> list[tuple[str, str]]:
    out = []
    for whose, who in (("COPYRIGHT HOLDERS", "COPYRIGHT HOLDER"), ("COPYRIGHT HOLDER", "COPYRIGHT HOLDER"), ("COPYRIGHT HOLDERS", "COPYRIGHT HOLDERS"), ("REGENTS", "REGENTS")):
        names = ["the University"] if who == "REGENTS" else ["the copyright holder", "the copyright holders"]
        texts = [("BSD-2-Clause", "")] + [("BSD-3-Clause", THIRD.format(name=x)) for x in names]
        for name, third in texts:
            text = BSD.format(third=third, whose=whose, who=who)
            out += [(name, text), (name, re.sub(r"(?m)^\d\. ", "* ", text))]
    return out


def variants(name: str, text: str) -> list[str]:
    """The text with each title and without, and without its closing part."""
    titles = TITLES.get(name, [])
    bare = text
    for t in titles:
        if bare.startswith(t + "\n"):
            bare = bare[len(t) :].lstrip("\n")
    out = [text, bare, *(f"{t}\n\n{bare}" for t in titles)]
    if name in BODY:
        out.append(text[text.index(BODY[name]) :])
    for x in list(out):
        out += [cut for m in CLOSING.finditer(x) for cut in (x[: m.start()], x[: m.end()] if "END" in m[1].upper()[:7] else "") if cut]
    return list(dict.fromkeys(out))


@lru_cache(1)
def listed() -> list[tuple[str, str]]:
    """(name, text) of every variant, the list of ``KNOWN`` first."""
    files = sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))
    texts = [*KNOWN, *_bsd(), *((p.stem, p.read_text("utf-8")) for p in files)]
    return [(name, v) for name, text in texts for v in variants(name, text)]
