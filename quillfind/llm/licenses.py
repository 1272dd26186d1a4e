"""License detection by ordered signature rules.

A rule is a regex over the lower-cased text, in which a run of blanks is one space, gated by keywords: it runs only on
texts that have all of its keywords as words, which one vectorised pass over the bytes finds out. Where a version may be
glued to a name (GPLv3, Apache2.0), the name before a number counts as a word. Rules are ordered by priority (texts of licenses before
full names with version, before identifiers, before addresses, before bare names). A detection is suppressed where its
interval lies in that of a detection of a higher priority, or of the same priority and greater length (then of the
earlier rule). Base phrases are found by word sequence, wherever their words stand consecutively, and are never
suppressed.

There are hundreds of signatures written by hand (sentences of license texts and names), and rules for names and versions
made from families. Suppression takes one pass over the detections in order of place.

Defined results: null and empty texts have no words, no labels and score 0; texts of any length are searched whole;
every row gives one row, repeated ones too; an empty table gives none; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import ALNUM, U, slices, split_words, word_hash
from .shared import session

#: Phrases whose every place counts, and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Score of a base phrase without any other detection.
BASE_SCORE = 0.9
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<label:string,rule:string,start:int,end:int,score:double>>"


@dataclass(frozen=True)
class Rule:
    name: str
    label: str
    priority: int
    keywords: tuple[str, ...]
    pattern: str
    score: float


#: Versioned families: label stem, name pattern, one keyword that every name has, versions.
_FAMILIES = (
    ("apache", r"apache(?: software)?(?: foundation)?", "apache", "1.0 1.1 2.0"),
    ("gpl", r"(?:gnu )?general public", "general", "1.0 2.0 3.0"),
    ("lgpl", r"(?:gnu )?(?:lesser|library) general public", "general", "2.0 2.1 3.0"),
    ("agpl", r"(?:gnu )?affero general public", "affero", "1.0 3.0"),
    ("gfdl", r"(?:gnu )?free documentation", "documentation", "1.1 1.2 1.3"),
    ("mpl", r"mozilla public", "mozilla", "1.0 1.1 2.0"),
    ("epl", r"eclipse public", "eclipse", "1.0 2.0"),
    ("cddl", r"common development and distribution", "distribution", "1.0 1.1"),
    ("cpl", r"common public", "common", "1.0"),
    ("eupl", r"european union public", "european", "1.0 1.1 1.2"),
    ("osl", r"open software", "open", "1.0 1.1 2.0 2.1 3.0"),
    ("afl", r"academic free", "academic", "1.1 1.2 2.0 2.1 3.0"),
    ("artistic", r"artistic", "artistic", "1.0 2.0"),
    ("cecill", r"cecill", "cecill", "1.0 1.1 2.0 2.1"),
    ("ofl", r"(?:sil )?open font", "font", "1.0 1.1"),
    ("busl", r"business source", "business", "1.1"),
    ("sspl", r"server side public", "server", "1.0"),
    ("lppl", r"latex project public", "latex", "1.0 1.1 1.2 1.3"),
    ("zpl", r"zope public", "zope", "1.1 2.0 2.1"),
    ("ecl", r"educational community", "educational", "1.0 2.0"),
    ("upl", r"universal permissive", "universal", "1.0"),
    ("mspl", r"microsoft public", "microsoft", "1.0"),
    ("bsl", r"boost software", "boost", "1.0"),
    ("php", r"php", "php", "3.0 3.01"),
    ("psf", r"python software foundation", "python", "2.0"),
    ("odbl", r"open database", "database", "1.0"),
    ("ncsa", r"university of illinois/ncsa open source", "ncsa", "1.0"),
)
_CC_KINDS = ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd")
_CC_WORDS = {"by": "attribution", "sa": "share[- ]?alike", "nd": "no[- ]?deriv(?:ative)?s?(?: works)?", "nc": "non[- ]?commercial"}
_CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
# Sentences and phrases of license texts, by hand: label, keyword, pattern on lower-cased text with single
# blanks. Where a label stands in several rows, each row is another sentence of that license.
_TEXTS = (
    ("mit", "permission", r"permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("mit", "permission", r"the above copyright notice and this permission notice shall be included in all copies"),
    ("mit", "sublicense", r"without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense,? and/or sell"),
    ("mit", "noninfringement", r"fitness for a particular purpose and noninfringement\. in no event shall the authors or copyright holders"),
    ("mit-0", "furnished", r"to permit persons to whom the software is furnished to do so\. the software is provided"),
    ("x11", "advertising", r"shall not be used in advertising or otherwise to promote the sale, use or other dealings in this software"),
    ("hpnd", "fee", r"permission to use, copy, modify,? and distribute this software and its documentation for any purpose and without fee"),
    ("hpnd-sell", "sell", r"permission to use, copy, modify, distribute,? and sell this software and its documentation"),
    ("isc", "permission", r"permission to use, copy, modify, and(?:/or)? distribute this software for any purpose"),
    ("isc", "negligence", r"whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance"),
    ("0bsd", "fee", r"permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted\. the software"),
    ("apache-2.0", "apache", r"licensed under the apache license,? version 2\.0 \(the .license.\)"),
    ("apache-2.0", "compliance", r"you may not use this file except in compliance with the license"),
    ("apache-2.0", "conditions", r"terms and conditions for use, reproduction, and distribution"),
    ("apache-2.0", "perpetual", r"perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable (?:copyright|\(except as stated)"),
    ("apache-2.0", "unless", r"unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an .as is. basis"),
    ("apache-1.1", "apache", r"this product includes software developed by the apache software foundation"),
    ("bsd-3-clause", "endorse", r"neither the names? of .{1,120}? nor the names of .{1,60}? may be used to endorse or promote"),
    ("bsd-3-clause", "endorse", r"the names? of the authors? may not be used to endorse or promote products"),
    ("bsd-2-clause", "redistributions", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-2-clause-views", "interpreted", r"should not be interpreted as representing official policies"),
    ("bsd", "redistributions", r"redistributions of source code must retain the above copyright notice"),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("bsd-4-clause", "advertising", r"all advertising materials mentioning features or use of this software must display"),
    ("bsd-3-clause-clear", "patent", r"no express or implied licenses to any party's patent rights are granted by this license"),
    ("bsd-3-clause-nuclear", "nuclear", r"not designed,? (?:licensed )?or intended for use in the design, construction, operation or maintenance of any nuclear facility"),
    ("bsd-source-code", "acknowledgement", r"redistributions of source code must retain the original copyright notice and this acknowledgement"),
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented"),
    ("zlib", "altered", r"altered source versions must be plainly marked as such"),
    ("zlib", "warranty", r"provided 'as-is', without any express or implied warranty\. in no event will the authors be held liable"),
    ("libpng", "portions", r"permission is hereby granted to use, copy, modify, and distribute this source code, or portions hereof"),
    ("libtiff", "leffler", r"the names of sam leffler and silicon graphics may not be used in any advertising"),
    ("ijg", "jpeg", r"this software is based in part on the work of the independent jpeg group"),
    ("freetype", "freetype", r"portions of this software are copyright .{1,40}? the freetype project"),
    ("openssl", "openssl", r"this product includes software developed by the openssl project"),
    ("ssleay", "cryptographic", r"this product includes cryptographic software written by eric young"),
    ("curl", "fee", r"permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies\. the software is provided .as is."),
    ("ntp", "suitability", r"makes no representations? about the suitability (?:of )?this software for any purpose"),
    ("unlicense", "unencumbered", r"free and unencumbered software released into the public domain"),
    ("unlicense", "dedicate", r"the author or authors of this software dedicate any and all copyright interest in the software to the public domain"),
    ("cc0-1.0", "waives", r"overtly, fully, permanently, irrevocably and unconditionally waives, abandons, and surrenders"),
    ("cc0-1.0", "neighboring", r"waived all copyright and related or neighboring rights"),
    ("wtfpl", "want", r"do what the f\w+ you want to public license"),
    ("wtfpl", "want", r"you just do what the f\w+ you want to"),
    ("beerware", "beer", r"you can buy me a beer in return"),
    ("postcardware", "postcard", r"(?:send|mail) (?:me|us) a postcard"),
    ("gpl", "foundation", r"under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl-or-later", "later", r"either version \d(?:\.\d)? of the license, or \(at your option\) any later version"),
    ("gpl", "useful", r"in the hope that it will be useful, but without any warranty"),
    ("gpl", "received", r"you should have received a copy of the gnu general public license along with"),
    ("gpl-2.0", "freedom", r"the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl-3.0", "copyleft", r"the gnu general public license is a free, copyleft license for software and other kinds of works"),
    ("gpl-3.0", "conveying", r"conveying verbatim copies"),
    ("lgpl", "published", r"under the terms of the gnu (?:lesser|library) general public license as published"),
    ("lgpl", "received", r"you should have received a copy of the gnu (?:lesser|library) general public license"),
    ("lgpl-2.1", "successor", r"the first released version of the lesser gpl\. it also counts as the successor of the gnu library public license"),
    ("lgpl-3.0", "supplemented", r"incorporates the terms and conditions of version 3 of the gnu general public license, supplemented by"),
    ("agpl", "affero", r"under the terms of the gnu affero general public license"),
    ("agpl-3.0", "remotely", r"all users interacting with it remotely through a computer network"),
    ("gfdl", "invariant", r"with no invariant sections, no front-cover texts"),
    ("gfdl", "documentation", r"permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation license"),
    ("gcc-exception", "runtime", r"gcc runtime library exception"),
    ("classpath-exception", "statically", r"linking this library statically or dynamically with other modules is making a combined work"),
    ("openssl-exception", "openssl", r"permission to link (?:the code of portions of )?this program with the openssl library"),
    ("autoconf-exception", "configure", r"configure script generated by autoconf under the same distribution terms"),
    ("bison-exception", "bison", r"as a special exception, you may create a larger work that contains part or all of the bison parser skeleton"),
    ("linux-syscall-note", "kernel", r"this copyright does \*?not\*? cover user programs that use kernel services by normal system calls"),
    ("llvm-exception", "llvm", r"llvm exceptions to the apache 2\.0 license"),
    ("mpl-2.0", "mozilla", r"this source code form is subject to the terms of the mozilla public license"),
    ("mpl-2.0", "incompatible", r"this source code form is [\x22']incompatible with secondary licenses"),
    ("mpl-1.1", "mozilla", r"the contents of this file are subject to the mozilla public license version 1\.1"),
    ("epl", "accompanying", r"this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("epl-1.0", "constitutes", r"any use, reproduction or distribution of the program constitutes recipient's acceptance of this agreement"),
    ("cddl", "distribution", r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("cpl-1.0", "provided", r"the accompanying program is provided under the terms of this common public license"),
    ("ipl-1.0", "ibm", r"the accompanying program is provided under the terms of this ibm public license"),
    ("eupl", "eupl", r"licensed under the eupl,? (?:version|v) ?1"),
    ("osl-3.0", "licensed", r"licensed under the open software license version 3\.0"),
    ("afl-3.0", "licensed", r"licensed under the academic free license version 3\.0"),
    ("artistic-1.0", "package", r"the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic-2.0", "modified", r"this license establishes the terms under which a given free software package may be copied, modified, distributed"),
    ("ofl-1.1", "font", r"this font software is licensed under the sil open font license"),
    ("ofl-1.1", "reserved", r"no modified version of the font software may use the reserved font name"),
    ("bitstream-vera", "vera", r"bitstream vera is a trademark of bitstream"),
    ("ubuntu-font", "ubuntu", r"ubuntu font licen[cs]e"),
    ("bsl-1.0", "boost", r"boost software license - version 1\.0"),
    ("bsl-1.0", "machine", r"solely in the form of machine-executable object code generated by a source language processor"),
    ("busl-1.1", "production", r"make non-production use of the licensed work"),
    ("sspl-1.0", "functionality", r"making the functionality of the program or modified version available to third parties as a service"),
    ("elastic-2.0", "managed", r"you may not provide the software to third parties as a hosted or managed service"),
    ("commons-clause", "sell", r"the grant of rights under the license will not include, and the license does not grant to you,? the right to sell"),
    ("polyform-noncommercial", "noncommercial", r"polyform noncommercial license"),
    ("polyform-small-business", "polyform", r"polyform small business license"),
    ("prosperity", "prosperity", r"the prosperity public license"),
    ("parity", "parity", r"the parity public license"),
    ("php-3.01", "php", r"this product includes php software, freely available from"),
    ("python-2.0", "python", r"psf is making python available to licensee on an .as is. basis"),
    ("cnri-python", "cnri", r"cnri is making python .{1,40}? available to licensee"),
    ("ruby", "verbatim", r"you may make and give away verbatim copies of the source form of the software without restriction"),
    ("tcl", "disclaimed", r"the following terms apply to all files associated with the software unless explicitly disclaimed in individual files"),
    ("vim", "vim", r"vim is charityware"),
    ("sleepycat", "accompanied", r"redistributions in any form must be accompanied by information on how to obtain complete source code"),
    ("qpl-1.0", "q", r"the q public license version 1\.0"),
    ("icu", "icu", r"icu license - icu 1\.8\.1 and later"),
    ("unicode", "unicode", r"unicode,? inc\.? license agreement - data files and software"),
    ("w3c", "w3c", r"w3c software (?:and document )?notice and license"),
    ("w3c", "licensee", r"by obtaining(?:, using)? and/or copying this work, you \(the licensee\) agree"),
    ("ncsa", "contributors", r"neither the names of .{1,120}? nor the names of its contributors may be used to endorse or promote products derived from this software"),
    ("nist-pd", "pursuant", r"pursuant to title 17 section 105 of the united states code this software is not subject to copyright"),
    ("us-government-work", "government", r"(?:this is a )?work of the (?:u\.s\.|united states) government"),
    ("json", "evil", r"the software shall be used for good, not evil"),
    ("ms-pl", "governs", r"this license governs use of the accompanying software\. if you use the software, you accept this license"),
    ("ms-rl", "reciprocal", r"microsoft reciprocal license"),
    ("apsl-2.0", "apple", r"apple public source license"),
    ("intel-acpi", "intel", r"intel grants recipient of the original code"),
    ("nvidia-eula", "nvidia", r"nvidia software license agreement"),
    ("oracle-bcl", "oracle", r"oracle binary code license agreement"),
    ("oracle-upl", "upl", r"the universal permissive license \(upl\)"),
    ("sun-bcl", "sun", r"sun microsystems, inc\. binary code license"),
    ("sun-rpc", "rpc", r"sun rpc is a product of sun microsystems"),
    ("rsa-md", "identified", r"identified as the .rsa data security, inc\. md\d message-digest algorithm"),
    ("hdf5", "hdf5", r"ncsa hdf5 \(hierarchical data format 5\) software library"),
    ("netcdf", "unidata", r"university corporation for atmospheric research/unidata"),
    ("lppl", "latex", r"this work may be distributed and/or modified under the conditions of the latex project public license"),
    ("odbl-1.0", "database", r"made available under the open database license"),
    ("odc-by-1.0", "attribution", r"open data commons attribution license"),
    ("pddl-1.0", "dedication", r"public domain dedication (?:and|&) licen[cs]e"),
    ("cdla-permissive", "community", r"community data license agreement (?:-|–) permissive"),
    ("cdla-sharing", "community", r"community data license agreement (?:-|–) sharing"),
    ("ogl-uk", "government", r"contains public sector information licensed under the open government licence"),
    ("etalab", "licence", r"licence ouverte(?: / open licence)?"),
    ("dl-de-by", "datenlizenz", r"datenlizenz deutschland"),
    ("cecill", "cecill", r"contrat de licence de logiciel libre cecill|cecill free software license agreement"),
    ("cc-by", "attribution", r"licensed under a creative commons attribution(?: \d\.\d)?(?: international)? license"),
    ("cc-by-sa", "attribution", r"licensed under a creative commons attribution-share ?alike"),
    ("cc-by-nc", "attribution", r"licensed under a creative commons attribution-non-?commercial"),
    ("cc-by-nd", "attribution", r"licensed under a creative commons attribution-no-?derivatives"),
    ("cc-wikipedia", "attribution", r"text is available under the creative commons attribution-sharealike license"),
    ("gfdl-wikipedia", "gfdl", r"dual-licensed under the gfdl and cc by-sa"),
    ("gutenberg", "gutenberg", r"you may copy it, give it away or re-use it under the terms of the project gutenberg license"),
    ("openrail", "openrail", r"\bopenrail\b"),
    ("rail", "responsible", r"responsible ai licen[cs]e"),
    ("llama-2", "llama", r"llama 2 community license agreement"),
    ("llama-3", "llama", r"(?:meta )?llama 3(?:\.\d)? community license agreement"),
    ("gemma", "gemma", r"gemma terms of use"),
    ("research-only", "research", r"for (?:academic |non-commercial )?research (?:purposes|use) only"),
    ("non-commercial", "commercial", r"non-commercial use only"),
    ("non-commercial", "noncommercial", r"noncommercial use only"),
    ("evaluation-only", "evaluation", r"for evaluation purposes only"),
    ("public-domain", "public", r"(?:dedicated|released|placed) (?:in)?to the public domain"),
    ("public-domain", "domain", r"(?:is|are) in the public domain"),
    ("copyleft-all-wrongs", "wrongs", r"all wrongs reserved"),
    ("eula", "agreement", r"end[- ]user licen[cs]e agreement"),
    ("shareware", "shareware", r"this (?:program|software) is shareware"),
    ("freeware", "freeware", r"this (?:program|software) is freeware"),
    ("proprietary", "reserved", r"all rights reserved"),
    ("proprietary", "proprietary", r"proprietary and confidential"),
    ("proprietary", "unauthorized", r"unauthorized (?:copying|reproduction|distribution) of this (?:file|document|material|software).{0,60}? is strictly prohibited"),
    ("proprietary", "confidential", r"confidential (?:and|or) trade secret information"),
    ("proprietary", "disclosed", r"may not be (?:disclosed|reproduced|copied).{0,80}? without (?:the )?(?:prior |express )*written (?:permission|consent)"),
)
# Names without a version, by hand: label, keyword, pattern.
_NAMES = (
    ("mit", "mit", r"mit licen[sc]e"), ("mit", "mit", r"licen[sc]ed under (?:the )?mit\b"), ("expat", "expat", r"expat licen[sc]e"), ("mit-0", "mit", r"\bmit-0\b|mit no attribution"),
    ("bsd", "bsd", r"bsd licen[sc]e"), ("bsd", "bsd", r"bsd-style licen[sc]e"), ("bsd-2-clause", "bsd", r"bsd[- ]2[- ]clause|simplified bsd|freebsd licen[sc]e"),
    ("bsd-3-clause", "bsd", r"bsd[- ]3[- ]clause|(?:new|modified|revised) bsd"), ("bsd-4-clause", "bsd", r"bsd[- ]4[- ]clause|original bsd licen[sc]e"), ("0bsd", "0bsd", r"\b0bsd\b"),
    ("isc", "isc", r"isc licen[sc]e"), ("zlib", "zlib", r"zlib licen[sc]e"), ("zlib", "zlib", r"zlib/libpng"), ("libpng", "libpng", r"libpng licen[sc]e"),
    ("unlicense", "unlicense", r"the unlicense"), ("wtfpl", "wtfpl", r"wtfpl"), ("cc0-1.0", "cc0", r"\bcc0(?:[- ]1\.0)?\b"), ("x11", "x11", r"x11 licen[sc]e"),
    ("gpl", "gpl", r"\bgnu gpl\b|\bgpl licen[sc]ed?\b|under the gpl\b"), ("lgpl", "lgpl", r"\bgnu lgpl\b|\blgpl licen[sc]ed?\b|under the lgpl\b"), ("agpl", "agpl", r"\bgnu agpl\b|\bagpl licen[sc]ed?\b|under the agpl\b"),
    ("fdl", "fdl", r"\bgnu fdl\b|\bgfdl\b"), ("copyleft", "copyleft", r"copyleft licen[sc]e"), ("ms-pl", "ms", r"\bms-pl\b"), ("ms-rl", "ms", r"\bms-rl\b"),
    ("openssl", "openssl", r"openssl licen[sc]e"), ("ssleay", "ssleay", r"ssleay licen[sc]e"), ("curl", "curl", r"curl licen[sc]e"), ("vim", "vim", r"vim licen[sc]e"),
    ("ruby", "ruby", r"ruby licen[sc]e"), ("python", "python", r"python licen[sc]e"), ("perl", "perl", r"same terms as perl"), ("ofl", "ofl", r"\bsil ofl\b"),
    ("json", "json", r"json licen[sc]e"), ("ncsa", "ncsa", r"ncsa licen[sc]e"), ("sleepycat", "sleepycat", r"sleepycat licen[sc]e"), ("tcl", "tcl", r"tcl/tk licen[sc]e"),
    ("eupl", "eupl", r"\beupl\b"), ("cecill", "cecill", r"\bcecill(?:-[bc])?\b"), ("hpnd", "hpnd", r"\bhpnd\b"), ("psf", "psf", r"\bpsf licen[sc]e"), ("sspl", "sspl", r"\bsspl\b"),
    ("elastic", "elastic", r"elastic licen[sc]e"), ("confluent", "confluent", r"confluent community licen[sc]e"), ("redis", "redis", r"redis source available licen[sc]e"), ("timescale", "timescale", r"timescale licen[sc]e"),
    ("ethical", "hippocratic", r"hippocratic licen[sc]e"), ("anti-996", "996", r"anti-996 licen[sc]e"), ("mulan", "mulan", r"mulan psl|mulan permissive"), ("blueoak", "oak", r"blue oak model licen[sc]e"),
    ("fair", "fair", r"fair licen[sc]e"), ("jabber", "jabber", r"jabber open source licen[sc]e"), ("nokia", "nokia", r"nokia open source licen[sc]e"), ("motosoto", "motosoto", r"motosoto open source licen[sc]e"),
    ("vovida", "vovida", r"vovida software licen[sc]e"), ("watcom", "watcom", r"sybase open watcom public licen[sc]e"), ("wxwindows", "wxwindows", r"wxwindows library licen[sc]e"), ("xnet", "x", r"x\.net licen[sc]e"),
    ("zend", "zend", r"zend engine licen[sc]e"), ("rpl", "reciprocal", r"reciprocal public licen[sc]e"), ("spl", "sun", r"sun public licen[sc]e"), ("sissl", "sun", r"sun industry standards source licen[sc]e"),
    ("nosl", "netizen", r"netizen open source licen[sc]e"), ("npl", "netscape", r"netscape public licen[sc]e"), ("nasa", "nasa", r"nasa open source agreement"), ("rscpl", "ricoh", r"ricoh source code public licen[sc]e"),
    ("catosl", "computer", r"computer associates trusted open source licen[sc]e"), ("cua", "cua", r"cua office public licen[sc]e"), ("entessa", "entessa", r"entessa public licen[sc]e"), ("frameworx", "frameworx", r"frameworx open licen[sc]e"),
    ("lucent", "lucent", r"lucent public licen[sc]e"), ("miros", "miros", r"the miros licen[sc]e"), ("multics", "multics", r"multics licen[sc]e"), ("naumen", "naumen", r"naumen public licen[sc]e"), ("oclc", "oclc", r"oclc research public licen[sc]e"),
    ("ogtsl", "group", r"open group test suite licen[sc]e"), ("realnetworks", "realnetworks", r"realnetworks public source licen[sc]e"), ("simpl", "simple", r"simple public licen[sc]e"), ("imlib2", "imlib2", r"imlib2 licen[sc]e"),
    ("ftl", "freetype", r"freetype (?:project )?licen[sc]e"), ("ijg", "jpeg", r"independent jpeg group licen[sc]e"), ("docbook", "docbook", r"docbook licen[sc]e"), ("gust", "gust", r"gust font licen[sc]e"), ("arphic", "arphic", r"arphic public licen[sc]e"),
    ("apache", "apache", r"apache-style licen[sc]e"), ("commercial", "commercial", r"commercial licen[sc]e"), ("proprietary", "proprietary", r"proprietary licen[sc]e"), ("open-source", "open", r"open source licen[sc]e"),
)


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All rules, in order."""
    out = [Rule(f"text-{k}", label, 50, (word,), pattern, 0.99) for k, (label, word, pattern) in enumerate(_TEXTS)]
    for stem, name, word, versions in _FAMILIES:
        for v in versions.split():
            number = re.escape(v.removesuffix(".0")) + r"(?:\.0)?" if v.endswith(".0") else re.escape(v)
            label = f"{stem}-{v}"
            full = rf"\b{name} licen[sc]e\)?,?(?: \({stem}\))?,? ?(?:version|v)?\.? ?{number}(?!\.?\d)"
            out.append(Rule(f"later-{label}", f"{label}-or-later", 45, (word, "later"), full + r",? or (?:\(at your option\) )?(?:any )?later", 0.98))
            out.append(Rule(f"name-{label}", label, 40, (word,), full, 0.97))
            out.append(Rule(f"id-{label}", label, 30, (stem,), rf"\b{stem}[- ]?v?{number}(?!\.?\d)(?:-only)?", 0.9))
        out.append(Rule(f"bare-{stem}", stem, 10, (word,), rf"\b{name} licen[sc]e", 0.8))
    for kind in _CC_KINDS:
        words = "[- ]+".join(_CC_WORDS[x] for x in kind.split("-"))
        for v in _CC_VERSIONS:
            label, number = f"cc-{kind}-{v}", re.escape(v)
            out.append(Rule(f"id-{label}", label, 30, ("cc",), rf"\bcc[- ]{kind}[- ]?v?{number}(?!\.?\d)", 0.95))
            out.append(Rule(f"name-{label}", label, 40, ("creative", "commons"), rf"creative commons {words} {number}", 0.97))
            out.append(Rule(f"url-{label}", label, 20, ("creativecommons",), rf"creativecommons\.org/licenses/{kind}/{number}", 0.95))
        out.append(Rule(f"bare-cc-{kind}", f"cc-{kind}", 10, ("cc",), rf"\bcc[- ]{kind}\b(?!-)", 0.8))
    out += [Rule(f"bare-name-{k}", label, 15, (word,), pattern, 0.85) for k, (label, word, pattern) in enumerate(_NAMES)]
    return tuple(sorted(out, key=lambda r: -r.priority))


#: Names that a version can follow without a break, in lower-cased bytes. None of them begins another.
GLUED = re.compile(rb"(" + "|".join(sorted({f[0] for f in _FAMILIES} | {"wtfpl"}, key=len, reverse=True)).encode() + rb")v?[0-9]")


def collapsed(text: str) -> tuple[str, np.ndarray | None]:
    """The text with each run of blanks as one space, and the places of its characters in the text (None: the same)."""
    if not re.search(r"[ \t\r\n]{2}", text):
        return re.sub(r"[\t\r\n]", " ", text), None
    code = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    blank = (code == 32) | (code == 9) | (code == 13) | (code == 10)
    keep = np.ones(len(code), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    return np.where(blank, np.uint32(32), code)[keep].tobytes().decode("utf-32-le"), np.flatnonzero(keep)


class Scanner:
    def __init__(self, ruleset: tuple[Rule, ...] | None = None):
        self.rules = ruleset or rules()
        self.compiled = [re.compile(r.pattern) for r in self.rules]
        words = sorted({w for r in self.rules for w in r.keywords})
        hashes = np.array([word_hash(w) for w in words], dtype=U)
        order = np.argsort(hashes)
        self.hashes, number = hashes[order], {words[k]: n for n, k in enumerate(order.tolist())}
        self.number = number
        self.needs = [frozenset(number[w] for w in r.keywords) for r in self.rules]
        self.priorities = sorted({r.priority for r in self.rules}, reverse=True)
        self.base = [([word_hash(w) for w in phrase.split()], label) for phrase, label in BASE]

    def detect(self, text: str, present: set[int]) -> list[tuple[int, int, int]]:
        """(rule, start, end) of the detections that are not suppressed, on a lower-cased text."""
        found = []
        for k, need in enumerate(self.needs):
            if need <= present:
                found += [(k, m.start(), m.end()) for m in self.compiled[k].finditer(text)]
        # By place, the longer and the earlier rule first, so that whatever may contain a detection comes before it. It
        # is suppressed if one of its own or of a higher priority reaches its end; a suppressed one may suppress too,
        # as what contains it contains the other.
        found.sort(key=lambda x: (x[1], -x[2], x[0]))
        kept: list[tuple[int, int, int]] = []
        reach = dict.fromkeys(self.priorities, -1)
        for k, s, e in found:
            own = self.rules[k].priority
            if not any(p >= own and far >= e for p, far in reach.items()):
                kept.append((k, s, e))
            reach[own] = max(reach[own], e)
        return kept

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple]:
        words = split_words(data, offsets, ALNUM)
        h, n, text_of = words.hash, len(offsets) - 1, words.text_of
        counts = np.diff(words.first)
        places = []
        for phrase, label in self.base:
            m = len(phrase)
            if len(h) >= m:
                hit = text_of[: len(h) - m + 1] == text_of[m - 1 :]
                for k, x in enumerate(phrase):
                    hit &= h[k : len(h) - m + 1 + k] == U(x)
                places += [(int(text_of[p]), int(p - words.first[text_of[p]]), label) for p in np.flatnonzero(hit)]
        base: dict[int, list[tuple[int, str]]] = {}
        for t, p, label in places:
            base.setdefault(t, []).append((p, label))
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        keyed = np.flatnonzero(self.hashes[at] == h)
        present: dict[int, set[int]] = {}
        for t, k in set(zip(text_of[keyed].tolist(), at[keyed].tolist())):
            present.setdefault(t, set()).add(k)
        blob = words.data.tobytes()
        for t in range(n):
            for m in GLUED.finditer(blob, int(offsets[t]), int(offsets[t + 1])):
                if (k := self.number.get(m[1].decode())) is not None:
                    present.setdefault(t, set()).add(k)
        out = []
        for t in range(n):
            mine = base.get(t, [])
            kept = []
            if t in present and any(need <= present[t] for need in self.needs):
                text = words.data[offsets[t] : offsets[t + 1]].tobytes().decode("utf-8", "replace")
                text, place = collapsed(text)
                kept = self.detect(text, present[t])
                if place is not None:
                    kept = [(k, int(place[s]), int(place[e - 1]) + 1) for k, s, e in kept]
            labels = {label for _, label in mine} | {self.rules[k].label for k, _, _ in kept}
            score = max([BASE_SCORE] * bool(mine) + [self.rules[k].score for k, _, _ in kept], default=0.0)
            spans = [{"label": self.rules[k].label, "rule": self.rules[k].name, "start": s, "end": e, "score": self.rules[k].score} for k, s, e in sorted(kept, key=lambda x: x[1:])]
            starts = [p for p, _ in mine]
            out.append((int(counts[t]), len(mine), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in mine})), ",".join(sorted(labels)), score, spans))
        return out


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ruleset: tuple[Rule, ...] | None = None) -> DataFrame:
    """One row per input row: word count, base places and labels, all labels, score, and the detections' spans in
    code points of the text. No shuffle."""
    session(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(ruleset)
        names = [x.split()[0] for x in SCHEMA.split(", ", 8)]
        span = pa.list_(pa.struct([("label", pa.string()), ("rule", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64(), span]
        for batch in batches:
            for at, data, offsets in slices(batch.column(1)):
                rows = scanner.scan(data, offsets)
                yield pa.record_batch([batch.column(0).slice(at, len(rows)), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)
