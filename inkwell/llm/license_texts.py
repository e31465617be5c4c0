"""Signatures of license texts: sentences of their bodies, headers of source files, notices and links.

Each is a regular expression over the lower-case words of a text, which single spaces separate; signs are gone, so
"Apache License, Version 2.0" reads "apache license version 2 0". (label, weight, expressions).
"""

from __future__ import annotations

V = r"(?: (?:version |v )?\d+(?: \d+)?)?"

#: Sentences that a license's own text has.
BODIES = (
    ("mit", 0.95, (
        r"permission is hereby granted free of charge to any person obtaining a copy",
        r"to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell",
        r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        r"in no event shall the authors or copyright holders be liable for any claim damages or other liability",
        r"the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability",
    )),
    ("mit-0", 0.9, (r"to whom the software is furnished to do so the software is provided as is",)),
    ("mit-advertising", 0.9, (r"except as contained in this notice the name of .{1,80}? shall not be used in advertising",)),
    ("x11", 0.9, (r"except as contained in this notice the name of the x consortium shall not be used",)),
    ("bsd", 0.9, (
        r"redistribution and use in source and binary forms(?: with or without modification)?",
        r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        r"redistributions in binary form must reproduce the above copyright notice this list of conditions",
        r"this software is provided by the copyright holders and contributors as is",
        r"in no event shall the (?:copyright (?:holder|owner)|regents|author)s? (?:or contributors )?be liable for any direct indirect incidental special exemplary or consequential damages",
    )),
    ("bsd-3-clause", 0.9, (
        r"neither the name of .{1,80}? nor the names of (?:its|their|any) contributors",
        r"the names? of .{1,60}? may not be used to endorse or promote products derived from this software",
    )),
    ("bsd-4-clause", 0.95, (r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment",)),
    ("bsd-patent", 0.95, (r"each copyright holder and contributor hereby grants to those receiving rights under this license a perpetual worldwide non exclusive no charge royalty free irrevocable",)),
    ("0bsd", 0.9, (r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is",)),
    ("isc", 0.95, (
        r"permission to use copy modify and(?: or)? distribute this software for any purpose(?: with or without fee is hereby granted)?",
        r"the author disclaims all warranties with regard to this software",
    )),
    ("ntp", 0.85, (r"permission to use copy modify and distribute this software and its documentation for any purpose",)),
    ("hpnd", 0.8, (r"that both that copyright notice and this permission notice appear in supporting documentation",)),
    ("apache-2.0", 0.95, (
        r"terms and conditions for use reproduction and distribution 1 definitions",
        r"you may not use this file except in compliance with the license you may obtain a copy of the license at",
        r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis",
        r"grant of copyright license subject to the terms and conditions of this license each contributor hereby grants to you",
        r"grant of patent license subject to the terms and conditions of this license each contributor hereby grants",
        r"if you institute patent litigation against any entity including a cross claim or counterclaim",
        r"see the license for the specific language governing permissions and limitations under the license",
    )),
    ("apache-1.1", 0.95, (
        r"this product includes software developed by the apache software foundation",
        r"the names apache and apache software foundation must not be used to endorse or promote products",
    )),
    ("gpl", 0.9, (
        r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
        r"this (?:program|software|library) is distributed in the hope that it will be useful but without any warranty",
        r"without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license",
        r"you should have received a copy of the gnu general public license along with",
        r"the gnu general public license is a free copyleft license for software and other kinds of works",
        r"the licenses for most software are designed to take away your freedom to share and change it",
        r"the licenses for most software and other practical works are designed to take away your freedom",
        r"everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed",
    )),
    ("gpl-2", 0.95, (
        r"gnu general public license version 2 june 1991",
        r"you may copy and distribute verbatim copies of the program s source code as you receive it in any medium",
        r"under the terms of the gnu general public license as published by the free software foundation either version 2",
        r"51 franklin street fifth floor boston ma 02110 1301 usa",
        r"59 temple place suite 330 boston ma 02111 1307 usa",
        r"675 mass ave cambridge ma 02139 usa",
    )),
    ("gpl-3", 0.95, (
        r"gnu general public license version 3 29 june 2007",
        r"under the terms of the gnu general public license as published by the free software foundation either version 3",
        r"you may convey verbatim copies of the program s source code as you receive it in any medium",
        r"protecting users legal rights from anti circumvention law",
        r"a covered work so as to satisfy simultaneously your obligations under this license",
    )),
    ("lgpl", 0.95, (
        r"this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license",
        r"you should have received a copy of the gnu (?:lesser|library) general public license along with",
        r"a program that contains no derivative of any portion of the library but is designed to work with the library",
    )),
    ("lgpl-2.1", 0.95, (r"gnu lesser general public license version 2 1 february 1999", r"under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1")),
    ("lgpl-3", 0.95, (r"gnu lesser general public license version 3 29 june 2007", r"an application is any work that makes use of an interface provided by the library", r"under the terms of the gnu lesser general public license as published by the free software foundation either version 3")),
    ("agpl", 0.95, (
        r"under the terms of the gnu affero general public license as published by",
        r"you should have received a copy of the gnu affero general public license along with",
        r"your modified version must prominently offer all users interacting with it remotely through a computer network",
    )),
    ("agpl-3", 0.95, (r"gnu affero general public license version 3 19 november 2007",)),
    ("gfdl", 0.95, (
        r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license",
        r"with no invariant sections no front cover texts and no back cover texts",
    )),
    ("mpl-1.1", 0.95, (r"the contents of this file are subject to the mozilla public license version 1 1", r"software distributed under the license is distributed on an as is basis without warranty of any kind either express or implied see the license for the specific language governing rights and limitations")),
    ("mpl-2.0", 0.95, (
        r"this source code form is subject to the terms of the mozilla public license v 2 0",
        r"if a copy of the mpl was not distributed with this file you can obtain one at",
        r"incompatible with secondary licenses",
    )),
    ("npl", 0.95, (r"the contents of this file are subject to the netscape public license",)),
    ("epl", 0.95, (
        r"this program and the accompanying materials are made available under the terms of the eclipse public license",
        r"the accompanying program is provided under the terms of this eclipse public license",
        r"any use reproduction or distribution of the program constitutes recipient s acceptance of this agreement",
    )),
    ("edl", 0.95, (r"made available under the terms of the eclipse distribution license",)),
    ("cpl", 0.95, (r"the accompanying program is provided under the terms of this common public license",)),
    ("ipl", 0.95, (r"the accompanying program is provided under the terms of this ibm public license",)),
    ("cddl", 0.95, (
        r"the contents of this file are subject to the terms of the common development and distribution license",
        r"when distributing the software include this license header notice in each file",
    )),
    ("cpal", 0.95, (r"the contents of this file are subject to the common public attribution license",)),
    ("eupl", 0.95, (
        r"licensed under the eupl" + V,
        r"the work is a work in progress which is continuously improved by numerous contributors",
        r"this european union public licence the eupl applies to the work",
    )),
    ("osl-3.0", 0.95, (r"licensed under the open software license version 3 0",)),
    ("afl-3.0", 0.95, (r"licensed under the academic free license version 3 0",)),
    ("ecl-2.0", 0.95, (r"licensed under the educational community license version 2 0",)),
    ("artistic", 0.9, (
        r"the intent of this document is to state the conditions under which a package may be copied",
        r"this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed",
        r"the copyright holder maintains some semblance of artistic control over the development of the package",
    )),
    ("perl", 0.9, (r"you (?:can|may) redistribute it and or modify it under the same terms as perl itself", r"under the same terms as (?:the )?perl (?:5 )?(?:programming language )?(?:system )?itself")),
    ("ruby", 0.9, (r"you may make and give away verbatim copies of the source form of the software without restriction",)),
    ("bsl-1.0", 0.95, (
        r"boost software license version 1 0 august 17th 2003",
        r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
        r"unless such copies or derivative works are solely in the form of machine executable object code",
    )),
    ("zlib", 0.95, (
        r"this software is provided as is without any express or implied warranty in no event will the authors be held liable",
        r"the origin of this software must not be misrepresented you must not claim that you wrote the original software",
        r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software",
        r"this notice may not be removed or altered from any source distribution",
    )),
    ("libpng", 0.95, (r"the png reference library is supplied as is", r"the contributing authors and group 42 inc disclaim all warranties")),
    ("libtiff", 0.9, (r"the names of sam leffler and silicon graphics may not be used in any advertising",)),
    ("ijg", 0.95, (r"this software is based in part on the work of the independent jpeg group",)),
    ("freetype", 0.95, (r"portions of this software are copyright .{1,40}? the freetype project",)),
    ("curl", 0.9, (r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",)),
    ("openssl", 0.95, (
        r"this product includes software developed by the openssl project for use in the openssl toolkit",
        r"the names openssl toolkit and openssl project must not be used to endorse or promote products",
        r"this product includes cryptographic software written by eric young",
    )),
    ("php", 0.95, (r"this product includes php software freely available from", r"this source file is subject to version \d (?:0 )?\d* ?of the php license")),
    ("python", 0.95, (
        r"psf is making python available to licensee on an as is basis",
        r"this license agreement is between the python software foundation psf and the individual or organization",
        r"beopen python open source license agreement version 1",
    )),
    ("postgresql", 0.95, (r"in no event shall the university of california be liable to any party for direct indirect special incidental or consequential damages",)),
    ("ncsa", 0.9, (r"to deal with the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell",)),
    ("icu", 0.9, (r"provided that the above copyright notice s? ?and this permission notice appear in all copies of the software and that both",)),
    ("unicode", 0.9, (r"permission is hereby granted free of charge to any person obtaining a copy of the unicode data files", r"unicode inc license agreement data files and software")),
    ("w3c", 0.9, (r"permission to copy modify and distribute this (?:work|software and its documentation) with or without modification for any purpose and without fee or royalty is hereby granted",)),
    ("vim", 0.9, (r"there are no restrictions on distributing unmodified copies of vim",)),
    ("tcl", 0.9, (r"this software is copyrighted by the regents of the university of california sun microsystems inc scriptics corporation",)),
    ("beerware", 0.95, (r"you can do whatever you want with this stuff if we meet some day and you think this stuff is worth it you can buy me a beer",)),
    ("wtfpl", 0.95, (r"do what the fuck you want to(?: public license)?",)),
    ("unlicense", 0.95, (
        r"this is free and unencumbered software released into the public domain",
        r"anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary",
        r"in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest",
    )),
    ("cc0", 0.95, (
        r"waived all copyright and related or neighboring rights",
        r"has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law",
        r"the person who associated a work with this deed has dedicated the work to the public domain",
        r"affirmer hereby overtly fully permanently irrevocably and unconditionally waives abandons and surrenders",
    )),
    ("cc", 0.8, (
        r"the work as defined below is provided under the terms of this creative commons public license",
        r"by exercising the licensed rights defined below you accept and agree to be bound by the terms and conditions of this creative commons",
        r"some rights reserved this work is licensed under a creative commons",
    )),
    ("odbl", 0.95, (r"this .{1,60}? is made available under the open database license", r"any rights in individual contents of the database are licensed under the database contents license")),
    ("odc-by", 0.95, (r"this .{1,60}? is made available under the open data commons attribution license",)),
    ("pddl", 0.95, (r"this .{1,60}? is made available under the public domain dedication and license",)),
    ("ofl-1.1", 0.95, (
        r"this font software is licensed under the sil open font license version 1 1",
        r"neither the font software nor any of its individual components in original or modified versions may be sold by itself",
        r"with reserved font name",
    )),
    ("lppl", 0.95, (r"this work may be distributed and or modified under the conditions of the latex project public license", r"this work has the lppl maintenance status")),
    ("ms-pl", 0.95, (r"this license governs use of the accompanying software if you use the software you accept this license",)),
    ("ms-rl", 0.95, (r"reciprocal grants for any file you distribute that contains code from the software",)),
    ("apsl-2.0", 0.95, (r"this file contains original code and or modifications of original code as defined in and that are subject to the apple public source license",)),
    ("sissl", 0.95, (r"the contents of this file are subject to the sun industry standards source license",)),
    ("qpl", 0.95, (r"this file is part of the .{1,40}? toolkit this file may be distributed under the terms of the q public license",)),
    ("sspl-1", 0.95, (r"if you make the functionality of the program or a modified version available to third parties as a service", r"server side public license version 1 october 16 2018")),
    ("busl-1.1", 0.95, (r"the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work", r"change date .{1,40}? change license")),
    ("elastic-2.0", 0.95, (r"you may not provide the software to third parties as a hosted or managed service",)),
    ("commons-clause", 0.95, (r"the grant of rights under the license will not include and the license does not grant to you the right to sell the software",)),
    ("prosperity", 0.9, (r"this license lets you use and share this software for free with a trial length time limit on commercial use",)),
    ("polyform", 0.9, (r"the licensor grants you a copyright license for the software to do everything you might do with the software that would otherwise infringe the licensor s copyright",)),
    ("mulan-psl-2", 0.95, (r"you can use this software according to the terms and conditions of the mulan psl v2",)),
    ("cecill", 0.95, (r"this software is governed by the cecill(?: [bc])? license under french law", r"as a counterpart to the access to the source code and rights to copy modify and redistribute granted by the license")),
    ("eiffel", 0.9, (r"permission is hereby granted to use copy modify and or distribute this package provided that copyright notices are retained unchanged",)),
    ("json", 0.95, (r"the software shall be used for good not evil",)),
    ("llama", 0.95, (r"greater than 700 million monthly active users in the preceding calendar month", r"built with meta llama \d")),
    ("openrail", 0.95, (r"you agree not to use the model or derivatives of the model in any way that violates", r"use based restrictions as referenced in paragraph 5")),
    ("gemma", 0.95, (r"gemma is provided under and subject to the gemma terms of use",)),
)

#: Notices that name no license but tell of rights, and weaker hints.
NOTICES = (
    ("public-domain", 0.9, (
        r"(?:released (?:in)?to|placed in(?:to)?|dedicated to|in) the public domain",
        r"no copyright is claimed(?: in the united states)?",
        r"(?:is|as) a work of the united states government",
        r"the author disclaims copyright to this source code",
    )),
    ("all-rights-reserved", 0.7, (r"all rights reserved", r"alle rechte vorbehalten", r"tous droits réservés", r"todos los derechos reservados")),
    ("copyright", 0.6, (r"copyright (?:c |© )?(?:\d{4})", r"© (?:copyright )?\d{4}")),
    ("proprietary", 0.8, (
        r"(?:this (?:software|document) (?:is|contains) )?(?:proprietary and confidential|confidential and proprietary)",
        r"unauthori[sz]ed (?:copying|use|reproduction|distribution) of this (?:file|software|document|material)(?: via any medium)? is (?:strictly )?prohibited",
        r"no part of this (?:publication|document|book|work) may be reproduced",
        r"for internal use only",
        r"may not be (?:copied|reproduced|distributed) without (?:the )?(?:prior )?(?:written |express )+(?:permission|consent)",
    )),
    ("end-user-agreement", 0.8, (r"end user licen[cs]e agreement", r"by (?:installing|downloading|using) (?:the|this) software you agree to (?:be bound by )?(?:the|these|this)")),
    ("non-commercial", 0.7, (r"for (?:non commercial|noncommercial|personal)(?: and (?:non commercial|noncommercial|personal|educational))? use only", r"free for (?:non commercial|personal|academic) use")),
    ("warranty-disclaimer", 0.4, (
        r"(?:as is )?without (?:any )?warrant(?:y|ies) of any kind",
        r"provided as is without (?:any )?(?:express or implied )?warrant(?:y|ies)",
        r"(?:there is )?no warranty not even for merchantability",
        r"use (?:it )?at your own risk",
    )),
    ("see-license", 0.5, (
        r"see (?:the )?(?:accompanying |enclosed |included )?(?:file )?licen[cs]e(?: txt| md)?(?: file)? for (?:more |full |license |copyright )?(?:details|information|terms)",
        r"see (?:the )?copying(?: txt)?(?: file)? for (?:more |full )?(?:details|information|terms)",
        r"governed by (?:a|an) .{1,30}? style licen[cs]e that can be found in the licen[cs]e file",
    )),
)

#: Links to licenses, as their words read.
LINKS = (
    ("apache-2.0", r"apache org licenses license 2 0"), ("mit", r"opensource org licen[cs]es mit"), ("gpl-2", r"gnu org licenses (?:old licenses )?gpl 2 0"),
    ("gpl-3", r"gnu org licenses gpl 3 0"), ("gpl", r"gnu org (?:copyleft|licenses) gpl(?: html)?"), ("lgpl-2.1", r"gnu org licenses (?:old licenses )?lgpl 2 1"),
    ("lgpl-3", r"gnu org licenses lgpl 3 0"), ("agpl-3", r"gnu org licenses agpl 3 0"), ("gfdl", r"gnu org (?:copyleft|licenses) fdl"), ("mpl-2.0", r"mozilla org mpl 2 0"),
    ("mpl-1.1", r"mozilla org mpl mpl 1 1"), ("epl-1.0", r"eclipse org legal epl v10"), ("epl-2.0", r"eclipse org legal epl (?:v20|2 0)"), ("edl-1.0", r"eclipse org org documents edl v10"),
    ("bsl-1.0", r"boost org license 1 0 txt"), ("unlicense", r"unlicense org"), ("wtfpl", r"wtfpl net"), ("cc0", r"creativecommons org publicdomain zero 1 0"),
    ("cc-by", r"creativecommons org licen[cs]es by \d \d"), ("cc-by-sa", r"creativecommons org licen[cs]es by sa \d \d"), ("cc-by-nd", r"creativecommons org licen[cs]es by nd \d \d"),
    ("cc-by-nc", r"creativecommons org licen[cs]es by nc \d \d"), ("cc-by-nc-sa", r"creativecommons org licen[cs]es by nc sa \d \d"), ("cc-by-nc-nd", r"creativecommons org licen[cs]es by nc nd \d \d"),
    ("bsd-2-clause", r"opensource org licen[cs]es bsd 2 clause"), ("bsd-3-clause", r"opensource org licen[cs]es bsd 3 clause"), ("isc", r"opensource org licen[cs]es isc"),
    ("ofl-1.1", r"scripts sil org ofl"), ("odbl-1.0", r"opendatacommons org licenses odbl"), ("odc-by-1.0", r"opendatacommons org licenses by"), ("pddl-1.0", r"opendatacommons org licenses pddl"),
    ("osl-3.0", r"opensource org licen[cs]es osl 3 0"), ("ms-pl", r"opensource org licen[cs]es ms pl"), ("ms-rl", r"opensource org licen[cs]es ms rl"), ("zlib", r"zlib net zlib license"),
    ("eupl", r"joinup ec europa eu .{1,40}? eupl"), ("lppl", r"latex project org lppl"), ("cddl", r"opensource org licen[cs]es cddl"), ("artistic-2.0", r"opensource org licen[cs]es artistic license 2 0"),
    ("mulan-psl-2", r"license coscl org cn mulanpsl2"), ("cecill", r"cecill info licen[cs]es"), ("elastic-2.0", r"elastic co licensing elastic license"), ("sspl-1", r"mongodb com licensing server side public license"),
)


def signatures() -> list[tuple[str, str, int, float]]:
    """(label, expression, priority, weight): bodies before links, notices last."""
    out = [(label, text, 6, weight) for label, weight, texts in BODIES for text in texts]
    out += [(label, text, 5, 0.9) for label, text in LINKS]
    return out + [(label, text, 2 if weight > 0.4 else 1, weight) for label, weight, texts in NOTICES for text in texts]
