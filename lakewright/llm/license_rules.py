"""Licence detection by ordered signature rules. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewright.llm.common import let, pick

#: Phrases of the base count with their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Licence families: label, keyword that each match of the pattern holds from a word's start, pattern of the name in lower-case words.
FAMILIES = (
    ("mit", "mit", "mit"),
    ("mit-0", "mit", "mit 0"),
    ("apache", "apache", "apache(?: software)?"),
    ("apache-1.1", "apache", "apache(?: software)?(?: license| licence)?(?: version)? (?:v ?)?1 1"),
    ("apache-2.0", "apache", "apache(?: software)?(?: license| licence)?(?: version)? (?:v ?)?2(?: 0)?"),
    ("gpl", "gpl", "(?:gnu )?gpl"),
    ("gpl", "general", "(?:gnu )?general public"),
    ("gpl-2.0", "gpl", "(?:gnu )?gpl ?v?(?:ersion)? ?2(?: 0)?"),
    ("gpl-2.0", "general", "(?:gnu )?general public license (?:v|version) ?2"),
    ("gpl-3.0", "gpl", "(?:gnu )?gpl ?v?(?:ersion)? ?3(?: 0)?"),
    ("gpl-3.0", "general", "(?:gnu )?general public license (?:v|version) ?3"),
    ("lgpl", "lgpl", "(?:gnu )?lgpl(?: v?[23](?: [01])?)?"),
    ("lgpl", "general", "(?:gnu )?(?:lesser|library) general public"),
    ("agpl", "agpl", "(?:gnu )?agpl(?: v?3(?: 0)?)?"),
    ("agpl", "affero", "(?:gnu )?affero general public"),
    ("bsd", "bsd", "bsd"),
    ("bsd-2-clause", "bsd", "(?:(?:simplified|freebsd|2 clause) bsd|bsd 2 clause)"),
    ("bsd-3-clause", "bsd", "(?:(?:new|revised|modified|3 clause) bsd|bsd 3 clause)"),
    ("bsd-4-clause", "bsd", "(?:(?:original|4 clause) bsd|bsd 4 clause)"),
    ("mpl", "mozilla", "mozilla public"),
    ("mpl", "mpl", "mpl(?: [12](?: [01])?)?"),
    ("epl", "eclipse", "eclipse public"),
    ("cddl", "cddl", "cddl(?: 1 [01])?"),
    ("cddl", "distribution", "common development and distribution"),
    ("cc0", "cc0", "cc0(?: 1 0)?"),
    ("cc-by", "cc", "cc by(?: [1-4] [05])?"),
    ("cc-by-sa", "cc", "cc by sa(?: [1-4] [05])?"),
    ("cc-by-nc", "cc", "cc by nc(?: [1-4] [05])?"),
    ("cc-by-nd", "cc", "cc by nd(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "cc", "cc by nc sa(?: [1-4] [05])?"),
    ("cc-by-nc-nd", "cc", "cc by nc nd(?: [1-4] [05])?"),
    ("cc-by", "creative", "creative commons attribution"),
    ("cc-by-sa", "attribution", "creative commons attribution share ?alike"),
    ("cc-by-nc", "attribution", "creative commons attribution non ?commercial"),
    ("isc", "isc", "isc"),
    ("zlib", "zlib", "zlib(?: libpng)?"),
    ("boost", "boost", "boost software"),
    ("unlicense", "unlicense", "unlicense"),
    ("wtfpl", "wtfpl", "wtfpl"),
    ("artistic", "artistic", "(?:perl )?artistic"),
    ("postgresql", "postgresql", "postgresql"),
    ("python", "python", "python software foundation"),
    ("ofl", "sil", "sil open font"),
    ("eupl", "eupl", "eupl(?: 1 [012])?"),
)
#: Forms of a licence statement: priority (larger wins), confidence, pattern before and after the name.
FORMS = (
    (5, 1.0, "spdx license identifier ", "(?: or later| only)?"),
    (4, 0.95, "(?:licensed|distributed|released|available|provided|published|redistributed) under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?", "(?: licen[cs]e)?(?: (?:version|v) ?[0-9]+(?: [0-9]+)?)?"),
    (4, 0.95, "(?:governed by|subject to|covered by|under) the terms (?:and conditions )?of the ", "(?: licen[cs]e)?"),
    (3, 0.8, "(?:see|read|copy of|accompanying|accept) the ", " licen[cs]e(?: for (?:more )?details)?"),
    (2, 0.7, "(?:licen[cs]e|licensing) (?:is |type )?(?:the )?", ""),
    (1, 0.6, "(?:the )?", " licen[cs]e(?: agreement| terms| text)?"),
)
#: Sentences of licence bodies, which name no licence: label, pattern. A literal head of some words comes first.
BODIES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of (?:this|the) software(?: and associated documentation files)?"),
    ("mit", "the above copyright notice and this permission notice (?:including the next paragraph )?shall be included in all copies or substantial portions of the software"),
    ("mit-0", "permission is hereby granted free of charge to any person obtaining a copy of this software (?:[^ ]+ ){1,60}?furnished to do so the software is provided as is"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2.0", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license"),
    ("gpl", "this program is free software(?: you can redistribute it and or modify it)?"),
    ("gpl-3.0", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed preamble the gnu general public license is a free copyleft license"),
    ("gpl-2.0", "the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl-3.0", "the licenses for most software and other practical works are designed to take away your freedom to share and change the works"),
    ("lgpl", "this library is free software(?: you can redistribute it and or modify it)?"),
    ("lgpl", "a program that contains no derivative of any portion of the library but is designed to work with the library"),
    ("agpl", "your modified version must prominently offer all users interacting with it remotely through a computer network"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted(?: provided that the following conditions are met)?"),
    ("bsd-3-clause", "neither the name of (?:[^ ]+ ){1,20}?(?:nor the names? of (?:its|their|any|other) contributors )?may be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("isc", "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("zlib", "the origin of this software must not be misrepresented"),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("wtfpl", "you just do what the fuck you want to"),
    ("mpl", "this source code form is subject to the terms of the mozilla public"),
    ("epl", "the accompanying program is provided under the terms of this eclipse public"),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("python", "psf hereby grants licensee a nonexclusive royalty free world wide license"),
    ("ofl", "permission is hereby granted free of charge to any person obtaining a copy of the font software"),
    ("artistic", "the intent of this document is to state the conditions under which a package may be copied"),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc0", "affirmer hereby overtly fully permanently irrevocably and unconditionally waives abandons and surrenders"),
)
#: Further sentences of licences and of notices that refer to one, by hand: label, pattern.
SENTENCES = (
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("mit", "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise"),
    ("mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies"),
    ("bsd", "this software is provided by the (?:copyright holders?|authors?|regents) and contributors as is and any express or implied warranties"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation"),
    ("bsd-3-clause", "may not be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-2-clause", "the views and conclusions contained in the software and documentation are those of the authors and should not be interpreted as representing official policies"),
    ("bsd", "use of this source code is governed by a bsd(?: style)? license that can be found in the license file"),
    ("apache-2.0", "you may obtain a copy of the license at http(?: www)? apache org licenses license 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license"),
    ("apache-2.0", "see the license for the specific language governing permissions and limitations under the license"),
    ("apache-2.0", "licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-2.0", "you must cause any modified files to carry prominent notices stating that you changed the files"),
    ("apache-2.0", "grant of patent license subject to the terms and conditions of this license each contributor hereby grants to you"),
    ("apache-2.0", "work shall mean the work of authorship whether in source or object form made available under the license"),
    ("apache-1.1", "this product includes software developed by the apache software foundation http www apache org"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty"),
    ("gpl", "you should have received a copy of the gnu general public license along with this (?:program|software|file)"),
    ("gpl-2.0", "either version 2 of the license or at your option any later version"),
    ("gpl-3.0", "either version 3 of the license or at your option any later version"),
    ("gpl-2.0", "gnu general public license version 2(?: june 1991)?"),
    ("gpl-3.0", "gnu general public license version 3(?: 29 june 2007)?"),
    ("gpl-2.0", "activities other than copying distribution and modification are not covered by this license they are outside its scope"),
    ("gpl-2.0", "you may copy and distribute verbatim copies of the program s source code as you receive it"),
    ("gpl-3.0", "you may convey verbatim copies of the program s source code as you receive it"),
    ("gpl-3.0", "to propagate a work means to do anything with it that without permission would make you directly or secondarily liable"),
    ("gpl-3.0", "no covered work shall be deemed part of an effective technological measure under any applicable law"),
    ("gpl-3.0", "the installation information required to install and execute modified versions of a covered work"),
    ("gpl", "as a special exception the (?:copyright holders?|author|free software foundation) (?:of this program )?gives? (?:you )?(?:unlimited )?permission to link"),
    ("lgpl", "this library is distributed in the hope that it will be useful but without any warranty"),
    ("lgpl", "you should have received a copy of the gnu (?:lesser|library) general public license along with this (?:library|program)"),
    ("lgpl", "a library means a collection of software functions and or data prepared so as to be conveniently linked with application programs"),
    ("lgpl", "an application is any work that makes use of an interface provided by the library but which is not otherwise based on the library"),
    ("lgpl", "gnu lesser general public license version (?:2 1|3)"),
    ("agpl", "you should have received a copy of the gnu affero general public license along with this program"),
    ("agpl", "gnu affero general public license version 3"),
    ("agpl", "the gnu affero general public license is designed specifically to ensure cooperation with the community in the case of network server software"),
    ("mpl", "if a copy of the mpl was not distributed with this file you can obtain one at http(?:s)? mozilla org mpl 2 0"),
    ("mpl", "incompatible with secondary licenses as defined by the mozilla public license"),
    ("mpl", "the contents of this file are subject to the mozilla public license version 1 [01]"),
    ("mpl", "software distributed under the license is distributed on an as is basis without warranty of any kind either express or implied see the license for the specific language"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("epl", "any use reproduction or distribution of the program constitutes recipient s acceptance of this agreement"),
    ("cddl", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("cddl", "when distributing covered code include this cddl header in each file"),
    ("cpl", "the accompanying program is provided under the terms of this common public license"),
    ("isc", "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties"),
    ("isc", "the software is provided as is and isc disclaims all warranties with regard to this software"),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("zlib", "this notice may not be removed or altered from any source distribution"),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"),
    ("libpng", "this copyright notice may not be removed or altered from any source or altered source distribution"),
    ("boost", "distributed under the boost software license version 1 0"),
    ("boost", "the copyright notices in the software and this entire statement including the above license grant this restriction and the following disclaimer must be included"),
    ("unlicense", "in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain"),
    ("unlicense", "for more information please refer to http(?:s)? unlicense org"),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed"),
    ("beerware", "as long as you retain this notice you can do whatever you want with this stuff"),
    ("cc0", "to the extent possible under law (?:the author|[^ ]+ [^ ]+) (?:has|have) (?:waived|dedicated) all copyright"),
    ("cc0", "the laws of most jurisdictions throughout the world automatically confer exclusive copyright and related rights"),
    ("cc-by", "this work is licensed under (?:a|the) creative commons attribution(?: [1-4] 0)? (?:international |unported |generic )?license"),
    ("cc-by-sa", "this work is licensed under (?:a|the) creative commons attribution share ?alike(?: [1-4] 0)? (?:international |unported |generic )?license"),
    ("cc-by-nc", "this work is licensed under (?:a|the) creative commons attribution non ?commercial(?: [1-4] 0)? (?:international |unported |generic )?license"),
    ("cc-by", "you must give appropriate credit provide a link to the license and indicate if changes were made"),
    ("cc-by-sa", "if you remix transform or build upon the material you must distribute your contributions under the same license as the original"),
    ("cc-by-nc", "you may not use the material for commercial purposes"),
    ("cc-by-nd", "if you remix transform or build upon the material you may not distribute the modified material"),
    ("ofl", "this font software is licensed under the sil open font license version 1 1"),
    ("ofl", "neither the font software nor any of its individual components in original or modified versions may be sold by itself"),
    ("artistic", "you may distribute verbatim copies of the source form of the standard version of this package"),
    ("artistic", "this is free software you can redistribute it and or modify it under the same terms as the perl 5 programming language system itself"),
    ("artistic", "the artistic license 2 0"),
    ("python", "this license agreement is between the python software foundation psf and the individual or organization"),
    ("postgresql", "in no event shall the university of california be liable to any party for direct indirect special incidental or consequential damages"),
    ("openssl", "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("openssl", "the names openssl toolkit and openssl project must not be used to endorse or promote products"),
    ("ncsa", "to deal with the software without restriction including without limitation the rights to use copy modify"),
    ("w3c", "permission to copy modify and distribute this software and its documentation with or without modification for any purpose and without fee or royalty is hereby granted"),
    ("eupl", "licensed under the eupl(?: version)? 1 [012]"),
    ("ms-pl", "this license governs use of the accompanying software if you use the software you accept this license"),
    ("public-domain", "this file is (?:in|placed in|released into) the public domain"),
    ("public-domain", "this work has been (?:placed in|released into|dedicated to) the public domain"),
    ("public-domain", "this software is (?:in|placed in|released into|dedicated to) the public domain"),
    ("public-domain", "this code has been (?:placed in|released into) the public domain"),
    ("public-domain", "the author disclaims copyright to this source code"),
    ("fair", "usage of the works is permitted provided that this instrument is retained with the works"),
    ("proprietary", "all rights reserved no part of this (?:publication|document|book|work) may be reproduced"),
    ("proprietary", "this software is the confidential and proprietary information of"),
    ("proprietary", "unauthorized copying of this file via any medium is strictly prohibited"),
    ("0bsd", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is"),
    ("aal", "redistributions of the code with or without modification must be accompanied by an attribution"),
    ("afl-3.0", "licensed under the academic free license version 3 0"),
    ("agpl", "if you modify the program your modified version must prominently offer all users interacting with it remotely through a computer network"),
    ("agpl", "our general public licenses are intended to guarantee your freedom to share and change all versions of a program to make sure it remains free software for all its users"),
    ("apache-2.0", "you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("apache-2.0", "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license"),
    ("apache-2.0", "if the work includes a notice text file as part of its distribution then any derivative works that you distribute must include a readable copy"),
    ("apache-1.1", "the names apache and apache software foundation must not be used to endorse or promote products derived from this software"),
    ("apsl", "this file contains original code and or modifications of original code as defined in and that are subject to the apple public source license"),
    ("artistic", "you may make and give away verbatim copies of the source form of the standard version of this package without restriction"),
    ("beerware", "if we meet some day and you think this stuff is worth it you can buy me a beer in return"),
    ("blueoak", "each contributor licenses you to do everything with this software that would otherwise infringe that contributor s copyright in it"),
    ("bsd-3-clause-clear", "no express or implied licenses to any party s patent rights are granted by this license"),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display the following acknowledg"),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("bsl-1.0", "unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor"),
    ("busl-1.1", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"),
    ("busl-1.1", "on the change date or the fourth anniversary of the first publicly available distribution of a specific version of the licensed work"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("cc0", "affirmer hereby overtly fully permanently irrevocably and unconditionally waives abandons and surrenders all of affirmer s copyright"),
    ("cecill", "this software is governed by the cecill(?: [abc])? license under french law and abiding by the rules of distribution of free software"),
    ("cecill", "ce logiciel est r(?:e|\u00e9)gi par la licence cecill soumise au droit fran(?:c|\u00e7)ais"),
    ("commons-clause", "the software is provided to you by the licensor under the license as defined below subject to the following condition"),
    ("cpal", "the contents of this file are subject to the common public attribution license version 1 0"),
    ("cpl", "this program and the accompanying materials are made available under the terms of the common public license"),
    ("curl", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("ecl-2.0", "licensed under the educational community license version 2 0"),
    ("elastic-2.0", "you may not provide the software to third parties as a hosted or managed service where the service provides users with access to any substantial set of the features"),
    ("elastic-2.0", "you may not move change disable or circumvent the license key functionality in the software"),
    ("epl-1.0", "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0"),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license(?: v| version)? ?2 0"),
    ("epl", "each contributor hereby grants recipient a non exclusive worldwide royalty free copyright license to reproduce prepare derivative works of publicly display"),
    ("eupl", "licensed under the european union public licen[cs]e"),
    ("eupl", "you may not use this work except in compliance with the licence"),
    ("freetype", "portions of this software are copyright the freetype project www freetype org all rights reserved"),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gfdl", "with no invariant sections no front cover texts and no back cover texts"),
    ("gpl", "you should have received a copy of the gnu general public license along with this program"),
    ("gpl-2.0", "the precise terms and conditions for copying distribution and modification follow"),
    ("gpl-3.0", "each time you convey a covered work the recipient automatically receives a license from the original licensors"),
    ("gpl-classpath", "as a special exception the copyright holders of this library give you permission to link this library with independent modules"),
    ("gpl-bison", "you may create a larger work that contains part or all of the bison parser skeleton"),
    ("gpl-gcc", "when you use gcc to compile a program gcc may combine portions of certain gcc header files and runtime libraries with the compiled program"),
    ("hpnd", "permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted"),
    ("icu", "permission is hereby granted free of charge to any person obtaining a copy of the unicode data files"),
    ("ijg", "this software is based in part on the work of the independent jpeg group"),
    ("intel", "redistribution and use in binary form without modification are permitted provided that"),
    ("isc", "the software is provided as is and the author disclaims all warranties with regard to this software"),
    ("json", "the software shall be used for good not evil"),
    ("lgpl", "you should have received a copy of the gnu lesser general public license along with this library"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("lgpl", "a program that contains no derivative of any portion of the library but is designed to work with the library by being compiled or linked with it"),
    ("libpng", "the origin of this source code must not be misrepresented"),
    ("libtiff", "the names of sam leffler and silicon graphics may not be used in any advertising or publicity relating to the software"),
    ("llvm", "with llvm exceptions see https llvm org license txt for license information"),
    ("lppl", "this work may be distributed and or modified under the conditions of the latex project public license"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "in no event shall the authors or copyright holders be liable for any claim damages or other liability"),
    ("mit-0", "permission is hereby granted free of charge to any person obtaining a copy of this software to deal in the software without restriction with no conditions"),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2.0", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl-2.0", "you may not remove or alter the substance of any license notices contained within the source code form of the covered software"),
    ("ms-pl", "if you bring a patent claim against any contributor over patents that you claim are infringed by the software your patent license from such contributor"),
    ("ms-rl", "for any file you distribute that contains code from the software you must provide recipients the source code to that file along with a copy of this license"),
    ("mulan", "is licensed under (?:the )?mulan psl v2"),
    ("nasa", "this open source agreement defines the rights of use reproduction distribution modification and redistribution of certain computer software"),
    ("ncsa", "neither the names of (?:the )?(?:llvm team )?university of illinois at urbana champaign nor the names of its contributors"),
    ("odbl", "this database is made available under the open database license"),
    ("odc-by", "made available under the open data commons attribution license"),
    ("ofl", "the font software may be modified altered or added to and in particular the designs of glyphs or characters in the fonts may be modified"),
    ("openldap", "redistribution and use of this software and associated documentation with or without modification are permitted provided that the following conditions are met"),
    ("osl-3.0", "licensed under the open software license version 3 0"),
    ("parity", "contribute all software that you develop deploy monitor or run with this software"),
    ("pddl", "this data is made available under the public domain dedication and license"),
    ("php", "this product includes php software freely available from"),
    ("php", "products derived from this software may not be called php nor may php appear in their name"),
    ("polyform", "any noncommercial purpose is a permitted purpose"),
    ("psf", "psf is making python available to licensee on an as is basis"),
    ("qpl", "this software may be distributed under the terms of the q public license"),
    ("ruby", "you can redistribute it and or modify it under either the terms of the 2 clause bsdl"),
    ("sgi-b", "the contents of this file are subject to the sgi free software license b"),
    ("sleepycat", "redistributions in any form must be accompanied by information on how to obtain complete source code for the db software"),
    ("sspl", "if you make the functionality of the program or a modified version available to third parties as a service you must make the service source code available"),
    ("tcl", "the authors hereby grant permission to use copy modify distribute and license this software and its documentation for any purpose"),
    ("unicode", "permission is hereby granted free of charge to any person obtaining a copy of data files and any associated documentation"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary"),
    ("upl-1.0", "subject to the condition set forth below permission is hereby granted to any person obtaining a copy of this software associated documentation and or data"),
    ("vim", "there are no restrictions on distributing unmodified copies of vim except that they must include this license text"),
    ("w3c", "this work is being provided by the copyright holders under the following license"),
    ("x11", "except as contained in this notice the name of the x consortium shall not be used in advertising"),
    ("zpl", "this software is subject to the provisions of the zope public license"),
    ("proprietary", "no license express or implied by estoppel or otherwise to any intellectual property rights is granted by this document"),
    ("proprietary", "you may not reverse engineer decompile or disassemble the software"),
    ("proprietary", "this source code is proprietary and confidential and may not be disclosed to third parties"),
)
BODY_PRIORITY, BODY_SURE = 3, 0.9


#: Licences by their names with a version alone, where a sentence about them is missing: label, keyword, pattern.
VERSIONED = (
    ("gpl-1.0", "gpl", "(?:gnu )?gpl ?v?1(?: 0)?"),
    ("gpl-2.0", "gpl", "(?:gnu )?gpl ?v?2(?: 0)?"),
    ("gpl-3.0", "gpl", "(?:gnu )?gpl ?v?3(?: 0)?"),
    ("lgpl-2.0", "lgpl", "(?:gnu )?lgpl ?v?2(?: 0)?"),
    ("lgpl-2.1", "lgpl", "(?:gnu )?lgpl ?v?2 1"),
    ("lgpl-3.0", "lgpl", "(?:gnu )?lgpl ?v?3(?: 0)?"),
    ("agpl-3.0", "agpl", "(?:gnu )?agpl ?v?3(?: 0)?"),
    ("apache-1.1", "apache", "apache v?1 1"),
    ("apache-2.0", "apache", "apache(?: license)? v?2 0"),
    ("bsd-2-clause", "bsd", "bsd 2 clause"),
    ("bsd-3-clause", "bsd", "bsd 3 clause"),
    ("bsd-4-clause", "bsd", "bsd 4 clause"),
    ("bsl-1.0", "bsl", "bsl 1 0"),
    ("cddl-1.0", "cddl", "cddl 1 0"),
    ("epl-1.0", "epl", "epl v?1 0"),
    ("epl-2.0", "epl", "epl v?2 0"),
    ("eupl-1.2", "eupl", "eupl v?1 2"),
    ("mpl-1.1", "mpl", "mpl v?1 1"),
    ("mpl-2.0", "mpl", "mpl v?2 0"),
    ("ofl-1.1", "ofl", "ofl 1 1"),
    ("cc0-1.0", "cc0", "cc0 1 0"),
)
VERSIONED_PRIORITY, VERSIONED_SURE = 1, 0.6
#: A permissive licence as the other choice beside a name with a version.
CHOICES = tuple((label, label, rf"(?:apache|bsd|gpl|lgpl|agpl|mpl|epl|bsl) [0-9](?: [0-9])?(?: clause)?(?: only| or later)? (?:or|and) {label}") for label in ("mit", "isc", "zlib"))

#: Identifiers of licences in the standard's list, as far as no family above has them.
SPDX_IDS = (
    "0BSD", "AAL", "AFL-2.1", "AFL-3.0", "AGPL-1.0", "AGPL-3.0", "APL-1.0", "APSL-2.0", "Apache-1.0", "Apache-1.1", "Apache-2.0", "Artistic-1.0", "Artistic-2.0", "BSD-1-Clause", "BSD-2-Clause", "BSD-2-Clause-Patent", "BSD-3-Clause", "BSD-3-Clause-Clear", "BSD-4-Clause", "BSL-1.0",
    "BUSL-1.1", "Beerware", "BlueOak-1.0.0", "CAL-1.0", "CC-BY-3.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-NC-SA-4.0", "CC-BY-ND-4.0", "CC-BY-SA-3.0", "CC-BY-SA-4.0", "CC0-1.0", "CDDL-1.0", "CDDL-1.1", "CECILL-2.1", "CECILL-B", "CECILL-C", "CPAL-1.0", "CPL-1.0", "ECL-2.0",
    "EFL-2.0", "EPL-1.0", "EPL-2.0", "EUPL-1.1", "EUPL-1.2", "Elastic-2.0", "FSFAP", "FTL", "GFDL-1.3", "GPL-1.0", "GPL-2.0", "GPL-3.0", "HPND", "ICU", "IJG", "IPL-1.0", "ISC", "Intel", "JSON", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "LPPL-1.3c", "Libpng", "MIT-0", "MPL-1.0", "MPL-1.1", "MPL-2.0",
    "MS-PL", "MS-RL", "MulanPSL-2.0", "NASA-1.3", "NCSA", "NPL-1.1", "NTP", "ODbL-1.0", "OFL-1.0", "OFL-1.1", "OLDAP-2.8", "OSL-3.0", "OpenSSL", "PDDL-1.0", "PHP-3.01", "PSF-2.0", "PostgreSQL", "Python-2.0", "QPL-1.0", "Ruby", "SISSL", "SSPL-1.0", "Sleepycat", "TCL", "UPL-1.0", "Unicode-DFS-2016", "Unlicense", "Vim", "W3C", "WTFPL", "X11", "ZPL-2.1", "Zlib",
)
SPDX_PRIORITY, SPDX_SURE = 5, 1.0
#: What may stand behind an identifier: a plus, which is no word, and an exception.
SPDX_TAIL = "(?: only| or later)?(?: with(?: [a-z0-9]+){1,4} exception(?: [0-9])*)?"


def spdx_words(identifier: str) -> str:
    """An identifier as lower-case words."""
    return " ".join("".join(c if c.isalnum() else " " for c in identifier.lower()).split())


def head(pattern: str) -> str:
    """The literal words that a body's pattern begins with."""
    literal = pattern.split("?")[0].split("(")[0].split("[")[0]
    return literal if literal == pattern else literal.rpartition(" ")[0]


#: All rules, in order (a longer label is a more specific licence and comes first): label, keyword, priority, confidence, pattern over a text of lower-case words with blanks around each.
RULES = (
    *((identifier.lower(), "spdx", SPDX_PRIORITY, SPDX_SURE, f"(?<= )spdx license identifier {spdx_words(identifier)}{SPDX_TAIL}(?= )") for identifier in sorted(SPDX_IDS, key=lambda x: (-len(x), x))),
    *((label, key, priority, sure, f"(?<= ){before}{name}{after}(?= )") for priority, sure, before, after in FORMS for label, key, name in sorted(FAMILIES, key=lambda f: -len(f[0]))),
    *((label, head(body), BODY_PRIORITY, BODY_SURE, f"(?<= ){body}(?= )") for label, body in (*BODIES, *SENTENCES)),
    *((label, key, VERSIONED_PRIORITY, VERSIONED_SURE, f"(?<= ){name}(?: only| or later)?(?= )") for label, key, name in VERSIONED),
    *((label, key, VERSIONED_PRIORITY, VERSIONED_SURE, f"(?<= ){name}(?= )") for label, key, name in CHOICES),
)

#: Keywords that patterns also take as the start of a longer word (gplv2).
JOINED = ("gpl", "lgpl", "agpl")
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _gate() -> str:
    """Alternatives are put together by their first letter, so that most words end the search at once."""
    heads = {key + ("" if key in JOINED else "(?![A-Za-z0-9])") for _, key, _ in (*FAMILIES, *VERSIONED, *CHOICES)} | {"spdx(?![A-Za-z0-9])"}
    heads |= {SEPARATORS.join(head(body).split(" ")[:4]) for _, body in (*BODIES, *SENTENCES)}
    by_letter: dict[str, list[str]] = {}
    for h in sorted(heads):
        by_letter.setdefault(h[0], []).append(h[1:])
    return "(?i)(?<![A-Za-z0-9])(?:" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in by_letter.items()) + ")"


#: A text is searched if it holds some family's keyword, as a word or for JOINED as a word's start, or the first words of some sentence.
GATE = _gate()
#: Items of an array that a running state passes at a time.
PART = 256


def _running(items: Column, zero: Column, add, combine, emit, kind: str) -> Column:
    """emit(state before the item, item) for each item in order, in time in proportion to the array.

    An array that grows with each item would be copied each time. So parts of PART items are summed up, the parts' states
    before them follow from those sums, and only inside a part an array grows.
    """
    none = F.array().cast(f"array<{kind}>")

    def inside(part: Column, before: Column) -> Column:
        start = F.struct(before.alias("at"), none.alias("out"))
        return F.aggregate(part, start, lambda acc, x: F.struct(add(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(emit(acc["at"], x))).alias("out")))["out"]

    def over(parts: Column) -> Column:
        start = F.struct(zero.alias("at"), F.array_repeat(zero, 0).alias("out"))
        sums = F.transform(parts, lambda p: F.aggregate(p, zero, add))
        before = F.aggregate(sums, start, lambda acc, x: F.struct(combine(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]
        return F.flatten(F.zip_with(parts, before, inside))

    cut = lambda x: F.transform(F.sequence(F.lit(1), F.size(x), F.lit(PART)), lambda i: F.slice(x, i, PART))
    return let(items, lambda x: F.when(F.size(x) == 0, none).otherwise(let(cut(x), over)))


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _blanks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _places(padded: Column, rule: Column) -> Column:
    """The rule's matches in padded as intervals of word numbers."""

    def placed(gaps: Column, found: Column) -> Column:
        both = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.struct(_blanks(g).alias("g"), _blanks(m).alias("m")))
        # blanks before a match, less the leading one, number its first word
        return _running(
            both,
            F.lit(0),
            lambda at, x: at + x["g"] + x["m"],
            lambda a, b: a + b,
            lambda at, x: F.struct((at + x["g"] - 1).alias("s"), (at + x["g"] + x["m"] - 1).alias("e")),
            "struct<s:int,e:int>",
        )

    pattern = rule["pattern"]
    return let(F.regexp_extract_all(padded, pattern, F.lit(0)), lambda found: F.when(F.size(found) == 0, F.array().cast("array<struct<s:int,e:int>>")).otherwise(placed(F.split(padded, pattern, -1), found)))


def detections(padded: Column) -> Column:
    """All rules' matches that no other suppresses, as structs (s, e, priority, sure, label).

    A match goes if an interval of no lower priority contains it (of equal intervals and priorities, the first rule's
    stays). One pass over the matches in order of start, with the furthest end of each priority so far.
    """
    # one expression: columns made one by one take seconds
    rules = F.expr("array(" + ", ".join(f"named_struct('key', '{k}', 'pattern', '{p}', 'priority', {n}, 'sure', {c}D, 'label', '{label}', 'no', {i})" for i, (label, k, n, c, p) in enumerate(RULES)) + ")")
    live = F.filter(rules, lambda r: F.contains(padded, r["key"]))
    each = F.flatten(
        F.transform(
            live,
            lambda r: F.transform(
                _places(padded, r),
                lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("e"), (-r["priority"]).alias("p"), r["no"].alias("no"), r["sure"].alias("sure"), r["label"].alias("label")),
            ),
        )
    )
    levels = sorted({n for _, _, n, _, _ in RULES})
    names = [f"m{n}" for n in levels]

    def add(ends: Column, x: Column) -> Column:
        return F.struct(*[F.when(-x["p"] == n, F.greatest(ends[m], -x["e"])).otherwise(ends[m]).alias(m) for n, m in zip(levels, names)])

    def emit(ends: Column, x: Column) -> Column:
        inside = F.lit(False)
        for n, m in zip(levels, names):
            inside = inside | ((-x["p"] <= n) & (ends[m] >= -x["e"]))
        return F.struct(x["s"].alias("s"), (-x["e"]).alias("e"), (-x["p"]).alias("priority"), x["sure"].alias("sure"), x["label"].alias("label"), inside.alias("inside"))

    passed = _running(
        F.sort_array(each),
        F.struct(*[F.lit(-1).alias(m) for m in names]),
        add,
        lambda a, b: F.struct(*[F.greatest(a[m], b[m]).alias(m) for m in names]),
        emit,
        "struct<s:int,e:int,priority:int,sure:double,label:string,inside:boolean>",
    )
    return F.transform(F.filter(passed, lambda x: ~x["inside"]), lambda x: F.struct(*[x[c].alias(c) for c in ("s", "e", "priority", "sure", "label")]))


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): the contract's columns and detections.

    Only texts that pass the gate are searched. Null text: no words. Null doc_id, repeated rows: each row
    its result. A very long text is searched whole, in time in proportion to it and its matches. Empty table: no rows.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    apart = F.trim(F.regexp_replace(t, SEPARATORS, " "))
    d = pick(docs, "doc_id", "text").select("doc_id", F.when(t.rlike(GATE), F.concat(F.lit(" "), _lower(apart), F.lit(" "))).alias("padded"), F.when(apart == "", 0).otherwise(_blanks(apart) + 1).cast("long").alias("n_words"))

    def starts(w: Column, phrase: str) -> Column:
        want = phrase.split(" ")
        at = F.sequence(F.lit(1), F.size(w) - len(want) + 1)

        def here(i: Column) -> Column:
            out = F.element_at(w, i.cast("int")) == want[0]
            for k, word in enumerate(want[1:], 1):
                out = out & (F.element_at(w, (i + k).cast("int")) == word)
            return out

        return F.when(F.size(w) < len(want), F.array().cast("array<int>")).otherwise(F.transform(F.filter(at, here), lambda i: (i - 1).cast("int")))

    found = F.when(
        F.col("padded").isNotNull(),
        F.struct(
            let(F.split(F.trim("padded"), " "), lambda w: F.struct(*[starts(w, phrase).alias(label) for phrase, label in BASE])).alias("base"),
            detections(F.col("padded")).alias("more"),
        ),
    )
    d = d.withColumn("_found", found)
    places = F.flatten(F.array(*[F.col("_found")["base"][label] for _, label in BASE]))
    base = F.coalesce(F.array_sort(F.filter(F.array(*[F.when(F.size(F.col("_found")["base"][label]) > 0, F.lit(label)) for _, label in BASE]), lambda x: x.isNotNull())), F.array().cast("array<string>"))
    more = F.coalesce(F.col("_found")["more"], F.array().cast("array<struct<s:int,e:int,priority:int,sure:double,label:string>>"))
    sure = F.coalesce(F.array_max(F.transform(more, lambda x: x["sure"])), F.lit(0.0))
    return d.select(
        "doc_id",
        "n_words",
        F.coalesce(F.size(places), F.lit(0)).cast("long").alias("_n"),
        F.array_min(places).cast("long").alias("first_word"),
        F.array_max(places).cast("long").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, F.transform(more, lambda x: x["label"])))), ",").alias("labels"),
        F.greatest(sure, F.when(F.size(base) > 0, 0.6).otherwise(0.0)).alias("score"),
        more.alias("detections"),
    ).withColumn("n_base", F.when(F.col("_n") < 0, 0).otherwise(F.col("_n")).cast("long"))


def contract(docs: DataFrame) -> DataFrame:
    return scan(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
