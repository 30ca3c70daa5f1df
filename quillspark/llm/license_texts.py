"""Signature rules of license notices and clauses (op 1), written by hand: what names a license without its title, and what tells versions apart.

label, priority, confidence, keywords (with bars between), pattern. Lower case; a space stands for any run of white space, ' ?' also for none.
A text that many licenses share has a general label and a low priority; one that only a version has, a high one.
"""

TEXTS = (
    # GNU notices: 'either version N, or any later version', and bodies by their own wording
    ("gpl-1.0", 52, 0.95, "redistribute", r"redistribute it and/or modify it under the terms of the gnu general public licen[cs]e as published by the free software foundation; either version 1\b"),
    ("gpl-2.0", 52, 0.95, "redistribute", r"redistribute it and/or modify it under the terms of the gnu general public licen[cs]e as published by the free software foundation; either version 2\b(?!\.1)"),
    ("gpl-3.0", 52, 0.95, "redistribute", r"redistribute it and/or modify it under the terms of the gnu general public licen[cs]e as published by the free software foundation, either version 3\b"),
    ("gpl-2.0", 52, 0.95, "modify", r"modify it under the terms of the gnu general public licen[cs]e,? version 2,? as published by the free software foundation"),
    ("gpl-3.0", 52, 0.95, "modify", r"modify it under the terms of the gnu general public licen[cs]e,? version 3,? as published by the free software foundation"),
    ("gpl", 32, 0.85, "redistribute", r"redistribute it and/or modify it under the terms of the gnu general public licen[cs]e"),
    ("lgpl-2.0", 53, 0.95, "modify", r"modify it under the terms of the gnu library general public licen[cs]e as published by the free software foundation; either version 2\b"),
    ("lgpl-2.1", 53, 0.95, "modify", r"modify it under the terms of the gnu lesser general public licen[cs]e as published by the free software foundation; either version 2\.1"),
    ("lgpl-3.0", 53, 0.95, "modify", r"modify it under the terms of the gnu lesser general public licen[cs]e as published by the free software foundation[,;] either version 3\b"),
    ("agpl-3.0", 53, 0.95, "modify", r"modify it under the terms of the gnu affero general public licen[cs]e as published by the free software foundation, either version 3\b"),
    ("gpl-2.0", 51, 0.95, "june", r"gnu general public licen[cs]e version 2, june 1991"),
    ("gpl-3.0", 51, 0.95, "june", r"gnu general public licen[cs]e version 3, 29 june 2007"),
    ("gpl-1.0", 51, 0.95, "february", r"gnu general public licen[cs]e version 1, february 1989"),
    ("lgpl-2.0", 51, 0.95, "june", r"gnu library general public licen[cs]e version 2, june 1991"),
    ("lgpl-2.1", 51, 0.95, "february", r"gnu lesser general public licen[cs]e version 2\.1, february 1999"),
    ("lgpl-3.0", 51, 0.95, "june", r"gnu lesser general public licen[cs]e version 3, 29 june 2007"),
    ("agpl-3.0", 51, 0.95, "november", r"gnu affero general public licen[cs]e version 3, 19 november 2007"),
    ("gpl", 31, 0.8, "freedom", r"the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl-3.0", 46, 0.9, "copyleft", r"the gnu general public license is a free, copyleft license for software and other kinds of works"),
    ("gpl-3.0", 44, 0.9, "propagate", r"to \"?propagate\"? a work means to do anything with it that,? without permission"),
    ("gpl-3.0", 44, 0.9, "tivoization|installation information", r"(?:tivoization|\"?installation information\"? for a user product means)"),
    ("gpl-2.0", 44, 0.9, "verbatim", r"you may copy and distribute verbatim copies of the program's source code as you receive it, in any medium"),
    ("gpl-2.0", 44, 0.85, "executable", r"the source code for a work means the preferred form of the work for making modifications to it\. for an executable work"),
    ("agpl-3.0", 47, 0.9, "remotely", r"all users interacting with it remotely through a computer network"),
    ("agpl-3.0", 46, 0.9, "cooperation", r"specifically designed to ensure cooperation with the community in the case of network server software"),
    ("lgpl-2.1", 46, 0.9, "successor", r"this is the first released version of the lesser gpl\. it also counts as the successor of the gnu library public license"),
    ("lgpl-2.0", 46, 0.9, "library", r"this is the first released version of the library gpl"),
    ("lgpl-3.0", 46, 0.9, "incorporates", r"this version of the gnu lesser general public license incorporates the terms and conditions of version 3"),
    ("gfdl-1.1", 52, 0.95, "document", r"copy, distribute and/or modify this document under the terms of the gnu free documentation licen[cs]e,? version 1\.1"),
    ("gfdl-1.2", 52, 0.95, "document", r"copy, distribute and/or modify this document under the terms of the gnu free documentation licen[cs]e,? version 1\.2"),
    ("gfdl-1.3", 52, 0.95, "document", r"copy, distribute and/or modify this document under the terms of the gnu free documentation licen[cs]e,? version 1\.3"),
    ("gfdl", 30, 0.8, "invariant", r"with no invariant sections,? (?:with )?no front-cover texts,? and (?:with )?no back-cover texts"),
    ("gpl-exception-classpath", 54, 0.9, "linking", r"linking this library statically or dynamically with other modules is making a combined work based on this library"),
    ("gpl-exception-gcc", 54, 0.9, "runtime library", r"gcc runtime library exception"),
    ("gpl-exception-autoconf", 54, 0.9, "configuration|configure", r"if you distribute this file as part of a program that contains a configuration script generated by autoconf|output of (?:the )?configure scripts? when processed by autoconf"),
    ("gpl-exception-bison", 54, 0.9, "bison", r"as a special exception, you may create a larger work that contains part or all of the bison parser skeleton"),
    ("gpl-exception-openssl", 54, 0.9, "openssl", r"as a special exception,.{0,120}permission to link the code .{0,120}openssl"),
    # Apache
    ("apache-2.0", 52, 1.0, "compliance", r"you may not use this (?:file|work|software|project) except in compliance with the licen[cs]e"),
    ("apache-2.0", 45, 0.9, "as is", r"software distributed under the licen[cs]e is distributed on an \"?as is\"? basis, without warranties or conditions of any kind"),
    ("apache-2.0", 51, 0.95, "january", r"apache licen[cs]e version 2\.0, january 2004"),
    ("apache-2.0", 44, 0.9, "contributor", r"each contributor hereby grants to you a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license"),
    ("apache-2.0", 44, 0.9, "patent", r"irrevocable \(except as stated in this section\) patent license to make, have made, use, offer to sell, sell, import, and otherwise transfer the work"),
    ("apache-1.1", 46, 0.9, "acknowledgment", r"the end-user documentation included with the redistribution, if any, must include the following acknowledgment: \"?this product includes software developed by the apache software foundation"),
    ("apache-1.0", 46, 0.9, "advertising", r"all advertising materials mentioning features or use of this software must display the following acknowledgment: \"?this product includes software developed by the apache group"),
    ("apache-1.1", 45, 0.85, "jakarta|apache", r"the names \"?(?:the jakarta project|apache)\"?.{0,80} must not be used to endorse or promote products derived from this software"),
    ("apache", 22, 0.6, "asf", r"licensed to the apache software foundation \(asf\) under one or more contributor licen[cs]e agreements"),
    # MIT and its relatives
    ("mit", 41, 0.95, "sublicense", r"without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software"),
    ("mit", 39, 0.9, "noninfringement", r"the software is provided \"?as is\"?, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement"),
    ("mit", 38, 0.9, "substantial portions", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit-0", 43, 0.95, "sublicense", r"publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so\. the software is provided"),
    ("mit-advertising", 43, 0.85, "marketing", r"included in all copies of the software, its documentation and marketing & publicity materials"),
    ("x11", 43, 0.9, "consortium", r"except as contained in this notice, the names? of the x consortium shall not be used in advertising"),
    ("mit-modern-variant", 42, 0.85, "notice and this permission", r"permission is hereby granted, without written agreement and without license or royalty fees, to use, copy, modify, and distribute this software and its documentation for any purpose, provided that the above copyright notice and this permission notice"),
    ("hpnd", 42, 0.9, "documentation", r"permission to use, copy, modify,? and distribute this software and its documentation for any purpose(?: and without fee|,? without fee,?(?: and without a written agreement)?) is hereby granted"),
    ("hpnd-sell", 43, 0.9, "sell", r"permission to use, copy, modify, distribute, and sell this software and its documentation for any purpose is hereby granted without fee"),
    ("isc", 42, 0.95, "appear in all copies", r"permission to use, copy, modify,? and(?:/or)? distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("0bsd", 42, 0.95, "granted", r"permission to use, copy, modify,? and/or distribute this software for any purpose with or without fee is hereby granted\."),
    ("isc", 36, 0.85, "disclaims", r"the software is provided \"?as is\"? and (?:the author|isc|internet systems consortium|[\w ]{1,40}) disclaims all warranties with regard to this software"),
    ("ntp", 43, 0.85, "delaware", r"the name university of delaware not be used in advertising|the university of delaware makes no representations about the suitability"),
    ("curl", 43, 0.9, "daniel", r"copyright \(c\) \d{4} - \d{4}, daniel stenberg"),
    ("bsl-1.0", 43, 0.95, "machine-executable", r"object code in the form of machine-executable object code generated by a source language processor|in the form of machine-executable object code generated by a source language processor"),
    ("bsl-1.0", 42, 0.9, "organization", r"permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this licen[cs]e"),
    ("ncsa", 44, 0.9, "illinois", r"neither the names of .{1,200}university of illinois.{0,80} nor the names of its contributors may be used to endorse"),
    ("json", 44, 0.9, "evil", r"the software shall be used for good, not evil"),
    ("beerware", 44, 0.9, "beer", r"if we meet some day, and you think this stuff is worth it, you can buy me a beer"),
    ("wtfpl", 44, 0.95, "just do", r"0\. you just do what the f\S+ you want to"),
    ("fsf-all-permissive", 43, 0.9, "royalty", r"copying and distribution of this file, with or without modification, are permitted in any medium without royalty provided the copyright notice and this notice are preserved"),
    ("fsf-unlimited", 43, 0.9, "unlimited", r"the free software foundation gives unlimited permission to copy,? and/or distribute it,? with or without modifications"),
    ("icu", 43, 0.85, "supporting", r"provided that the above copyright notice\(s\) and this permission notice appear in all copies of the software and that both the above copyright notice\(s\) and this permission notice appear in supporting documentation"),
    ("unicode", 43, 0.9, "data files", r"(?:to any person obtaining a copy of|of) the unicode data files and any associated documentation"),
    # BSD by its clauses
    ("bsd", 31, 0.8, "binary form", r"redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation"),
    ("bsd", 30, 0.75, "source code", r"redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("bsd-2-clause", 33, 0.8, "materials provided", r"in the documentation and/or other materials provided with the distribution\. this software is provided by"),
    ("bsd-3-clause", 43, 0.95, "endorse", r"neither the names? of [^.]{1,200} nor the names of (?:its|their|any|other) contributors may be used to endorse or promote products"),
    ("bsd-3-clause", 42, 0.9, "endorse", r"the names? of (?:the )?(?:author|authors|copyright holders?|contributors?) (?:may|must) not be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", 45, 0.95, "advertising", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd-4-clause-uc", 47, 0.95, "berkeley", r"this product includes software developed by the university of california,? berkeley and its contributors"),
    ("bsd-3-clause-clear", 48, 0.95, "patent", r"no express or implied licenses to any party's patent rights are granted by this license"),
    ("bsd-2-clause-patent", 48, 0.95, "patent", r"each copyright holder and contributor hereby grants to those receiving rights under this license a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable .{0,80}patent license"),
    ("bsd-3-clause-nuclear", 48, 0.95, "nuclear", r"not designed, licensed or intended for use in the design, construction, operation or maintenance of any nuclear facility"),
    ("bsd-source-code", 41, 0.85, "source code", r"redistributions of source code must retain the copyright notices as they appear in each source code file"),
    ("bsd-protection", 48, 0.9, "protection", r"bsd protection licen[cs]e"),
    ("bsd", 28, 0.7, "exemplary", r"in no event shall .{1,120} be liable for any direct, indirect, incidental, special, exemplary, or consequential damages"),
    ("bsd-2-clause-views", 46, 0.9, "views", r"the views and conclusions contained in the software and documentation are those of the authors and should not be interpreted as representing official policies"),
    ("bsd", 45, 0.85, "bsd-style", r"(?:use of this source code is )?governed by a bsd-style licen[cs]e"),
    ("bsd", 24, 0.7, "bsd", r"(?:under|by) (?:the|a) bsd licen[cs]e"),
    ("openssl", 46, 0.95, "toolkit", r"this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("ssleay", 46, 0.95, "eric", r"this product includes (?:cryptographic )?software written by eric young"),
    # Mozilla, Eclipse, CDDL, CPL and other file-level copyleft
    ("mpl-1.0", 52, 0.95, "netscape|mozilla", r"the contents of this file are subject to the (?:netscape|mozilla) public licen[cs]e version 1\.0"),
    ("mpl-1.1", 52, 0.95, "mozilla", r"the contents of this file are subject to the mozilla public licen[cs]e version 1\.1"),
    ("mpl-2.0", 52, 1.0, "mozilla", r"this source code form is subject to the terms of the mozilla public licen[cs]e, v\. ?2\.0"),
    ("mpl-2.0", 46, 0.9, "secondary licenses", r"incompatible with secondary licenses, as defined by the mozilla public licen[cs]e"),
    ("mpl-1.1", 45, 0.85, "covered code", r"\"?covered code\"? means the original code or modifications or the combination of the original code and modifications"),
    ("mpl-2.0", 45, 0.85, "covered software", r"\"?covered software\"? means source code form to which the initial contributor has attached the notice in exhibit a"),
    ("npl-1.1", 52, 0.95, "netscape", r"the contents of this file are subject to the netscape public licen[cs]e,? version 1\.1"),
    ("epl-1.0", 52, 0.95, "eclipse", r"made available under the terms of the eclipse public licen[cs]e v(?:ersion)? ?1\.0"),
    ("epl-2.0", 52, 0.95, "eclipse", r"made available under the terms of the eclipse public licen[cs]e v(?:ersion)?\.? ?2\.0"),
    ("epl-2.0", 46, 0.9, "secondary licenses", r"this source code may also be made available under the following secondary licenses when the conditions for such availability set forth in the eclipse public licen[cs]e"),
    ("edl-1.0", 52, 0.95, "distribution license", r"eclipse distribution licen[cs]e,?(?: -)? v(?:ersion)?\.? ?1\.0"),
    ("cpl-1.0", 46, 0.9, "common public", r"the accompanying program is provided under the terms of this common public licen[cs]e"),
    ("ipl-1.0", 46, 0.9, "ibm public", r"the accompanying program is provided under the terms of this ibm public licen[cs]e"),
    ("cddl-1.0", 52, 0.95, "common development", r"the contents of this file are subject to the terms of the common development and distribution licen[cs]e"),
    ("cddl-1.1", 48, 0.9, "cddl", r"either the gnu general public licen[cs]e version 2 only .{0,20}or the common development and distribution licen[cs]e ?\(\"?cddl\"?\)"),
    ("eupl-1.1", 52, 0.95, "eupl", r"licensed under the eupl,? version 1\.1"),
    ("eupl-1.2", 52, 0.95, "eupl", r"licensed under the eupl,?(?: version)? 1\.2"),
    ("cecill-2.1", 52, 0.95, "cecill", r"cecill (?:free software )?licen[cs]e (?:agreement )?(?:version|v\.?) ?2\.1"),
    ("cecill-2.0", 52, 0.95, "cecill", r"cecill licen[cs]e (?:version|v\.?) ?2(?:\.0)?\b(?!\.1)"),
    ("cecill-b", 52, 0.95, "cecill-b", r"governed by the cecill-b licen[cs]e"),
    ("cecill-c", 52, 0.95, "cecill-c", r"governed by the cecill-c licen[cs]e"),
    ("cecill", 40, 0.85, "cecill", r"régi par la licence cecill|governed by the cecill licen[cs]e"),
    ("rpl-1.5", 50, 0.9, "reciprocal public", r"reciprocal public licen[cs]e(?: version)? 1\.5"),
    ("qpl-1.0", 50, 0.9, "q public", r"\bq public licen[cs]e(?: version)? 1\.0"),
    ("sissl", 50, 0.9, "sun industry", r"sun industry standards source licen[cs]e"),
    ("spl-1.0", 50, 0.9, "sun public", r"sun public licen[cs]e(?: version)? 1\.0"),
    ("cpal-1.0", 50, 0.9, "attribution license", r"common public attribution licen[cs]e(?: version)? 1\.0"),
    ("lppl-1.3c", 50, 0.95, "latex", r"under the conditions of the latex project public licen[cs]e, either version 1\.3c?"),
    ("lppl", 40, 0.85, "latex", r"latex project public licen[cs]e"),
    ("artistic-1.0", 46, 0.9, "copyright holder", r"the intent of this document is to state the conditions under which a package may be copied, such that the copyright holder maintains some semblance of artistic control"),
    ("artistic-2.0", 46, 0.9, "modified versions", r"this license establishes the terms under which a given free software package may be copied, modified, distributed, and/or redistributed\. the intent is that the copyright holder maintains some artistic control(?=.{0,900}modified versions)|you may distribute your modified version as source .{0,200}modified versions? of the package"),
    ("perl", 44, 0.9, "perl", r"(?:under )?the same terms as perl(?: ?5)? itself"),
    ("ms-pl", 46, 0.9, "trademark", r"this license does not grant you rights to use any contributors' name, logo, or trademarks(?=.{0,2500}patent claims)"),
    ("vim", 46, 0.9, "uganda", r"vim is charityware\. you can use and copy it as much as you like, but you are encouraged to make a donation .{0,80}uganda"),
    ("sleepycat", 46, 0.9, "accompanying software", r"redistributions in any form must be accompanied by information on how to obtain complete source code for .{1,80}accompanying software"),
    ("zlib", 42, 0.9, "misrepresented", r"the origin of this software must not be misrepresented; you must not claim that you wrote the original software"),
    ("libpng-2.0", 47, 0.9, "png|contributing", r"png reference library authors|the contributing authors and group 42, inc\. disclaim all warranties"),
    ("bzip2", 45, 0.9, "bzip2", r"\bbzip2 and libbzip2(?: licen[cs]e)? v(?:ersion)? ?1\.0\.\d"),
    ("imagemagick", 45, 0.9, "imagemagick", r"\bimagemagick licen[cs]e"),
    ("ijg", 45, 0.9, "jpeg", r"this software is based in part on the work of the independent jpeg group"),
    ("ftl", 45, 0.9, "freetype", r"(?:the )?freetype project licen[cs]e|portions of this software are copyright .{0,20}the freetype project"),
    ("tcl", 45, 0.9, "scriptics", r"this software is copyrighted by the regents of the university of california, sun microsystems, inc\., scriptics corporation"),
    ("w3c", 45, 0.9, "w3c", r"\bw3c(?:®)? software (?:notice and|and document notice and)? ?licen[cs]e"),
    ("zpl-2.1", 45, 0.9, "zope", r"zope public licen[cs]e \(?zpl\)? version 2\.1"),
    ("zpl-2.0", 45, 0.9, "zope", r"zope public licen[cs]e \(?zpl\)? version 2\.0"),
    ("python-2.0", 46, 0.9, "python", r"psf is making python available to licensee on an \"?as is\"? basis"),
    ("cnri-python", 46, 0.9, "cnri", r"cnri (?:open source|python) licen[cs]e"),
    ("php-3.01", 46, 0.9, "php", r"this product includes php software, freely available from"),
    ("postgresql", 46, 0.95, "written agreement", r"permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted"),
    ("unlicense", 43, 0.95, "heirs", r"we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors"),
    ("cc0-1.0", 52, 0.95, "waive|waiving", r"has (?:waived all copyright and related or neighboring rights|dedicated the work to the public domain by waiving all of (?:his or her|their) rights to the work)"),
    ("public-domain", 35, 0.8, "disclaims copyright", r"the author disclaims copyright to this source code\. in place of a legal notice, here is a blessing"),
    # Creative Commons by their long names and versions
    ("cc-by", 55, 1.0, "attribution", r"creative commons attribution 4\.0 international"),
    ("cc-by", 55, 1.0, "attribution", r"creative commons attribution 3\.0 unported"),
    ("cc-by-sa", 55, 1.0, "attribution", r"creative commons attribution-share ?alike 4\.0 international"),
    ("cc-by-sa", 55, 1.0, "attribution", r"creative commons attribution-share ?alike 3\.0 unported"),
    ("cc-by-nc", 55, 1.0, "attribution", r"creative commons attribution-non-?commercial 4\.0 international"),
    ("cc-by-nd", 55, 1.0, "attribution", r"creative commons attribution-no-?derivatives 4\.0 international"),
    ("cc-by-nc-sa", 55, 1.0, "attribution", r"creative commons attribution-non-?commercial-share ?alike 4\.0 international"),
    ("cc-by-nc-nd", 55, 1.0, "attribution", r"creative commons attribution-non-?commercial-no-?derivatives 4\.0 international"),
    ("cc-by", 27, 0.8, "attribution", r"licence creative commons attribution"),
    ("cc-by", 27, 0.8, "namensnennung", r"creative[- ]commons[- ]lizenz,? namensnennung|namensnennung 4\.0 international"),
    ("cc-by-sa", 28, 0.8, "namensnennung", r"namensnennung ?- ?weitergabe unter gleichen bedingungen"),
    ("cc-by-sa", 28, 0.8, "partage", r"attribution ?- ?partage dans les mêmes conditions"),
    ("cc-by-nc", 28, 0.8, "utilisation", r"attribution ?- ?pas d[’']utilisation commerciale"),
    ("cc-by-sa", 28, 0.8, "compartirigual|reconocimiento", r"(?:reconocimiento|atribución)-?compartirigual"),
    ("cc-by-nc", 28, 0.8, "nocomercial", r"(?:reconocimiento|atribución)-?nocomercial"),
    # Data, models, and sources that are open for reading only
    ("odbl-1.0", 48, 0.9, "database", r"made available under the open database licen[cs]e"),
    ("odc-by-1.0", 48, 0.95, "data commons", r"open data commons attribution licen[cs]e"),
    ("cdla-permissive-2.0", 48, 0.95, "community data", r"community data licen[cs]e agreement ?[-–—] ?permissive ?[-–—,]? version 2\.0"),
    ("cdla-permissive-1.0", 48, 0.95, "community data", r"community data licen[cs]e agreement ?[-–—] ?permissive ?[-–—,]? version 1\.0"),
    ("cdla-sharing-1.0", 48, 0.95, "community data", r"community data licen[cs]e agreement ?[-–—] ?sharing ?[-–—,]? version 1\.0"),
    ("ogl-uk-3.0", 48, 0.95, "government", r"open government licen[cs]e v(?:ersion)? ?3\.0"),
    ("ogl-uk-2.0", 48, 0.95, "government", r"open government licen[cs]e v(?:ersion)? ?2\.0"),
    ("etalab-2.0", 48, 0.95, "ouverte", r"licence ouverte(?: / open licence)? (?:version )?2\.0"),
    ("dl-de-by-2.0", 48, 0.95, "datenlizenz", r"datenlizenz deutschland ?[-–—] ?namensnennung ?[-–—] ?version 2\.0"),
    ("dl-de-zero-2.0", 48, 0.95, "datenlizenz", r"datenlizenz deutschland ?[-–—] ?zero ?[-–—] ?version 2\.0"),
    ("openrail", 48, 0.9, "responsible ai", r"responsible ai licen[cs]es?"),
    ("llama-2", 56, 0.95, "llama", r"llama 2 community licen[cs]e agreement"),
    ("llama-3", 56, 0.95, "llama", r"(?:meta )?llama 3(?:\.\d)? community licen[cs]e agreement"),
    ("busl-1.1", 48, 0.9, "change date", r"effective on the change date, or the fourth anniversary of the first publicly available distribution"),
    ("sspl-1.0", 48, 0.9, "functionality", r"if you make the functionality of the program or a modified version available to third parties as a service"),
    ("elastic-2.0", 48, 0.9, "hosted or managed", r"you may not provide the software to third parties as a hosted or managed service"),
    ("commons-clause", 57, 0.95, "commons clause", r"commons clause(?: license condition)? v(?:ersion)? ?1\.0|“?commons clause”? license condition"),
    ("polyform-noncommercial-1.0", 48, 0.95, "polyform", r"polyform noncommercial licen[cs]e(?: version)? 1\.0\.0"),
    ("polyform-small-business-1.0", 48, 0.95, "polyform", r"polyform small business licen[cs]e(?: version)? 1\.0\.0"),
    ("parity-7.0", 48, 0.95, "parity", r"\bthe parity public licen[cs]e(?: 7\.0\.0)?"),
    ("hippocratic", 48, 0.95, "hippocratic", r"hippocratic licen[cs]e(?: version)?(?: \d\.\d)?"),
    ("ofl-1.1", 48, 0.95, "reserved font", r"with reserved font names?"),
    ("bitstream-vera", 48, 0.9, "bitstream", r"bitstream vera is a trademark of bitstream, inc"),
    ("cpol", 48, 0.9, "code project", r"(?:the )?code project open licen[cs]e"),
    ("proprietary", 14, 0.7, "confidential", r"(?:this|the) (?:software|document|file|information) is (?:the )?confidential and proprietary"),
    ("proprietary", 14, 0.7, "unauthorized", r"unauthorized copying of this file, via any medium,? is strictly prohibited"),
    ("proprietary", 13, 0.6, "reproduced", r"no part of this (?:publication|book|document|work) may be reproduced"),
    ("proprietary", 13, 0.6, "reproduction", r"toute reproduction(?:,)? (?:même partielle|totale ou partielle|interdite)"),
    ("proprietary", 13, 0.6, "nachdruck|vervielfältigung", r"(?:nachdruck|vervielfältigung),? auch auszugsweise|vervielfältigung .{0,40}nur mit (?:schriftlicher )?genehmigung"),
    ("proprietary", 13, 0.6, "prohibida", r"prohibida (?:su|la) reproducción(?: total o parcial)?"),
)
