"""The signatures of operator 10, one a line, written by hand.

Each is a label, a keyword that every text it matches holds, a regular expression
over lower-case words one space apart, a priority and a weight.  Names of files
and of fields count 4, titles with a version and sentences of a grant 4 or 5,
bare names 1 to 3.
"""

SIGNATURES = (
    # MIT and its kin
    ("mit", "ed under", "licen[sc]ed under (the )?(terms of )?(the )?mit( licen[sc]e)?", 3, 1.0),
    ("mit", "under mit", "(released|distributed|available|published|provided|shared) under mit( licen[sc]e)?", 3, 1.0),
    ("mit", "under the mit", "(released|distributed|available|published|provided|shared) under the mit( licen[sc]e)?", 3, 1.0),
    ("mit", "terms of the mit", "under the terms of the mit( licen[sc]e)?", 3, 1.0),
    ("mit", "mit licen", "under (the )?mit licen[sc]e", 3, 0.95),
    ("mit", "mit licen", "subject to (the )?(terms of )?(the )?mit licen[sc]e", 3, 0.9),
    ("mit", "identifier mit", "spdx license identifier mit", 4, 1.0),
    ("mit", "licen", "licen[sc]e (is )?mit", 2, 0.7),
    ("mit", "mit licen", "(the )?mit licen[sc]e", 2, 0.7),
    ("mit", "expat", "expat licen[sc]e", 2, 0.7),
    ("mit", "licenses mit", "opensource org licenses mit", 4, 0.95),
    ("mit", "mit x11", "mit x11 licen[sc]e", 3, 0.8),
    ("mit", "permission is hereby", "permission is hereby granted free of charge to any person obtaining a copy", 4, 1.0),
    ("mit", "permission notice", "the above copyright notice and this permission notice shall be included in all", 4, 0.95),
    ("mit", "merge publish", "rights to use copy modify merge publish distribute sublicense and or sell copies", 4, 0.95),
    ("mit-0", "mit no attribution", "mit no attribution( licen[sc]e)?", 4, 0.9),
    ("mit-0", "identifier mit 0", "spdx license identifier mit 0", 5, 1.0),
    ("mit-advertising", "advertising", "mit licen[sc]e with advertising clause", 4, 0.9),
    ("x11", "x11", "x11 licen[sc]e", 2, 0.7),
    ("x11", "x11", "spdx license identifier x11", 4, 1.0),
    ("x11", "x consortium", "the name of the x consortium shall not be used in advertising", 4, 0.95),
    # Apache
    ("apache-1.0", "apache", "apache( software)? licen[sc]e (version|v) ?1 0", 4, 1.0),
    ("apache-1.0", "apache", "spdx license identifier apache 1 0", 4, 1.0),
    ("apache-1.1", "apache", "apache( software)? licen[sc]e (version|v) ?1 1", 4, 1.0),
    ("apache-1.1", "apache", "spdx license identifier apache 1 1", 4, 1.0),
    ("apache-1.1", "apache group", "this product includes software developed by the apache group", 4, 0.9),
    ("apache-2", "apache", "licen[sc]ed under (the )?(terms of )?(the )?apache licen[sc]e (version|v) ?2( 0)?", 5, 1.0),
    ("apache-2", "apache", "licen[sc]ed under (the )?apache( licen[sc]e)? 2( 0)?", 4, 1.0),
    ("apache-2", "apache", "(released|distributed|available|published|provided) under (the )?(terms of )?(the )?apache( licen[sc]e)?( version| v)? ?2( 0)?", 4, 1.0),
    ("apache-2", "apache", "apache( software)? licen[sc]e (version|v) ?2( 0)?", 4, 1.0),
    ("apache-2", "apache", "apache licen[sc]e 2( 0)?", 3, 0.9),
    ("apache-2", "apache", "apache 2( 0)? licen[sc]e", 3, 0.9),
    ("apache-2", "apache", "spdx license identifier apache 2 0", 4, 1.0),
    ("apache-2", "apache", "www apache org licenses license 2 0", 4, 0.95),
    ("apache-2", "apache", "opensource org licenses apache 2 0", 4, 0.95),
    ("apache-2", "asf", "licen[sc]ed to the asf under one or more contributor", 4, 0.9),
    ("apache", "apache", "apache( software)? licen[sc]e", 1, 0.6),
    # BSD
    ("bsd-0", "0bsd", "0bsd", 3, 0.8),
    ("bsd-0", "bsd", "(bsd )?zero clause bsd( licen[sc]e)?", 4, 0.9),
    ("bsd-1-clause", "bsd", "bsd 1 clause( licen[sc]e)?", 3, 0.9),
    ("bsd-2-clause", "bsd", "bsd 2 clause( licen[sc]e)?", 3, 0.9),
    ("bsd-2-clause", "bsd", "(2|two) clause bsd( licen[sc]e)?", 3, 0.9),
    ("bsd-2-clause", "bsd", "simplified bsd( licen[sc]e)?", 3, 0.9),
    ("bsd-2-clause", "freebsd", "under (the )?(terms of )?(the )?freebsd licen[sc]e", 3, 0.95),
    ("bsd-2-clause", "freebsd", "freebsd licen[sc]e", 2, 0.7),
    ("bsd-2-clause", "bsd", "spdx license identifier bsd 2 clause", 4, 1.0),
    ("bsd-2-clause", "bsd", "opensource org licenses bsd 2 clause", 4, 0.95),
    ("bsd-2-clause-patent", "patent", "bsd 2 clause plus patent( licen[sc]e)?", 4, 0.9),
    ("bsd-3-clause", "bsd", "bsd 3 clause( licen[sc]e)?", 3, 0.9),
    ("bsd-3-clause", "bsd", "(3|three) clause bsd( licen[sc]e)?", 3, 0.9),
    ("bsd-3-clause", "bsd", "(new|modified|revised) bsd( licen[sc]e)?", 3, 0.9),
    ("bsd-3-clause", "bsd", "spdx license identifier bsd 3 clause", 4, 1.0),
    ("bsd-3-clause", "bsd", "opensource org licenses bsd 3 clause", 4, 0.95),
    ("bsd-3-clause", "neither the name", "neither the name of .{1,80} nor the names of its contributors", 4, 0.95),
    ("bsd-3-clause-clear", "bsd", "bsd 3 clause clear( licen[sc]e)?", 4, 0.9),
    ("bsd-4-clause", "bsd", "bsd 4 clause( licen[sc]e)?", 3, 0.9),
    ("bsd-4-clause", "bsd", "(4|four) clause bsd( licen[sc]e)?", 3, 0.9),
    ("bsd-4-clause", "bsd", "original bsd( licen[sc]e)?", 3, 0.9),
    ("bsd-4-clause", "bsd", "spdx license identifier bsd 4 clause", 4, 1.0),
    ("bsd-4-clause", "advertising materials", "all advertising materials mentioning features or use of this software must display", 4, 0.95),
    ("bsd", "bsd", "licen[sc]ed under (the )?(terms of )?(the )?bsd( licen[sc]e)?", 2, 0.8),
    ("bsd", "bsd", "(released|distributed|available) under (the )?(terms of )?(the )?bsd licen[sc]e", 2, 0.8),
    ("bsd", "bsd style", "bsd style licen[sc]e", 1, 0.6),
    ("bsd", "bsd", "bsd licen[sc]e", 1, 0.6),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification", 2, 0.8),
    # GNU general public
    ("gpl-1", "general public", "(gnu )?general public licen[sc]e (version|v) ?1( 0)?", 4, 1.0),
    ("gpl-1", "gpl", "(gnu )?gpl ?v? ?1( 0)?", 3, 0.9),
    ("gpl-2", "general public", "(gnu )?general public licen[sc]e (version|v) ?2( 0)?", 4, 1.0),
    ("gpl-2", "general public", "(gnu )?general public licen[sc]e as published by the free software foundation( either)? version 2", 5, 1.0),
    ("gpl-2", "gpl", "licen[sc]ed under (the )?(terms of )?(the )?(gnu )?gpl( version| v)? ?2( 0)?", 4, 1.0),
    ("gpl-2", "gpl", "(gnu )?gpl( version| v)? ?2( 0)?( only)?", 3, 0.9),
    ("gpl-2", "gplv2", "(gnu )?gplv2", 3, 0.9),
    ("gpl-2", "gpl", "spdx license identifier gpl 2 0( only)?", 4, 1.0),
    ("gpl-2-or-later", "gpl", "spdx license identifier gpl 2 0 or later", 5, 1.0),
    ("gpl-2-or-later", "general public", "general public licen[sc]e as published by the free software foundation either version 2 of the licen[sc]e or at your option any later version", 6, 1.0),
    ("gpl-2-classpath", "classpath", "gpl( version| v)? ?2( 0)? with (the )?classpath exception", 5, 0.95),
    ("gpl-3", "general public", "(gnu )?general public licen[sc]e (version|v) ?3( 0)?", 4, 1.0),
    ("gpl-3", "general public", "(gnu )?general public licen[sc]e as published by the free software foundation( either)? version 3", 5, 1.0),
    ("gpl-3", "gpl", "licen[sc]ed under (the )?(terms of )?(the )?(gnu )?gpl( version| v)? ?3( 0)?", 4, 1.0),
    ("gpl-3", "gpl", "(gnu )?gpl( version| v)? ?3( 0)?( only)?", 3, 0.9),
    ("gpl-3", "gplv3", "(gnu )?gplv3", 3, 0.9),
    ("gpl-3", "gpl", "spdx license identifier gpl 3 0( only)?", 4, 1.0),
    ("gpl-3-or-later", "gpl", "spdx license identifier gpl 3 0 or later", 5, 1.0),
    ("gpl-3-or-later", "general public", "general public licen[sc]e as published by the free software foundation either version 3 of the licen[sc]e or at your option any later version", 6, 1.0),
    ("gpl", "general public", "(gnu )?general public licen[sc]e", 1, 0.6),
    ("gpl", "gpl", "(released|distributed|available|licen[sc]ed) under (the )?(terms of )?(the )?(gnu )?gpl", 2, 0.7),
    ("gpl", "gnu", "www gnu org licenses gpl", 2, 0.7),
    # lesser, affero and documentation
    ("lgpl-2", "library general", "(gnu )?library general public licen[sc]e( version| v)? ?2( 0)?", 5, 1.0),
    ("lgpl-2", "lgpl", "spdx license identifier lgpl 2 0( only| or later)?", 4, 1.0),
    ("lgpl-2.1", "lesser general", "(gnu )?lesser general public licen[sc]e (version|v) ?2 1", 5, 1.0),
    ("lgpl-2.1", "lgpl", "(gnu )?lgpl( version| v)? ?2 1", 3, 0.9),
    ("lgpl-2.1", "lgpl", "spdx license identifier lgpl 2 1( only| or later)?", 4, 1.0),
    ("lgpl-3", "lesser general", "(gnu )?lesser general public licen[sc]e (version|v) ?3( 0)?", 5, 1.0),
    ("lgpl-3", "lgpl", "(gnu )?lgpl( version| v)? ?3( 0)?", 3, 0.9),
    ("lgpl-3", "lgpl", "spdx license identifier lgpl 3 0( only| or later)?", 4, 1.0),
    ("lgpl", "lesser general", "(gnu )?lesser general public licen[sc]e", 2, 0.7),
    ("lgpl", "lgpl", "under (the )?(terms of )?(the )?(gnu )?lgpl", 2, 0.7),
    ("agpl-1", "affero", "affero general public licen[sc]e (version|v) ?1( 0)?", 5, 1.0),
    ("agpl-3", "affero", "(gnu )?affero general public licen[sc]e (version|v) ?3( 0)?", 5, 1.0),
    ("agpl-3", "agpl", "(gnu )?agpl( version| v)? ?3( 0)?", 3, 0.9),
    ("agpl-3", "agplv3", "agplv3", 3, 0.9),
    ("agpl-3", "agpl", "spdx license identifier agpl 3 0( only| or later)?", 4, 1.0),
    ("agpl", "affero", "(gnu )?affero general public licen[sc]e", 2, 0.7),
    ("gfdl-1.1", "free documentation", "(gnu )?free documentation licen[sc]e (version|v) ?1 1", 5, 1.0),
    ("gfdl-1.2", "free documentation", "(gnu )?free documentation licen[sc]e (version|v) ?1 2", 5, 1.0),
    ("gfdl-1.3", "free documentation", "(gnu )?free documentation licen[sc]e (version|v) ?1 3", 5, 1.0),
    ("gfdl-1.3", "gfdl", "spdx license identifier gfdl 1 3( only| or later)?", 4, 1.0),
    ("gfdl", "free documentation", "(gnu )?free documentation licen[sc]e", 2, 0.7),
    ("gfdl", "invariant sections", "with no invariant sections", 2, 0.6),
    # Mozilla, Eclipse and other weak copyleft
    ("mpl-1.0", "mozilla", "mozilla public licen[sc]e( version| v)? ?1 0", 4, 1.0),
    ("mpl-1.1", "mozilla", "mozilla public licen[sc]e( version| v)? ?1 1", 4, 1.0),
    ("mpl-1.1", "identifier mpl", "spdx license identifier mpl 1 1", 4, 1.0),
    ("mpl-2", "mozilla", "mozilla public licen[sc]e( version| v)? ?2( 0)?", 4, 1.0),
    ("mpl-2", "identifier mpl", "spdx license identifier mpl 2 0", 4, 1.0),
    ("mpl-2", "mpl 2", "mpl 2( 0)?", 3, 0.9),
    ("mpl-2", "mpl v", "mpl v(ersion)? ?2( 0)?", 3, 0.9),
    ("mpl-2", "mozilla", "this source code form is subject to the terms of the mozilla public licen[sc]e", 3, 0.95),
    ("mpl", "mozilla", "mozilla public licen[sc]e", 1, 0.6),
    ("npl-1.1", "netscape", "netscape public licen[sc]e( version| v)? ?1 1", 4, 1.0),
    ("epl-1", "eclipse", "eclipse public licen[sc]e( version| v)? ?1( 0)?", 4, 1.0),
    ("epl-1", "epl", "spdx license identifier epl 1 0", 4, 1.0),
    ("epl-2", "eclipse", "eclipse public licen[sc]e( version| v)? ?2( 0)?", 4, 1.0),
    ("epl-2", "epl", "spdx license identifier epl 2 0", 4, 1.0),
    ("epl", "eclipse", "eclipse public licen[sc]e", 1, 0.6),
    ("edl-1", "eclipse", "eclipse distribution licen[sc]e( version| v)? ?1( 0)?", 4, 1.0),
    ("cddl-1", "cddl", "cddl( version| v)? ?1( 0)?", 3, 0.9),
    ("cddl-1", "cddl", "spdx license identifier cddl 1 0", 4, 1.0),
    ("cddl-1", "common development", "common development and distribution( licen[sc]e)?( version| v)? ?1( 0)?( licen[sc]e)?", 4, 1.0),
    ("cddl-1.1", "cddl", "cddl( version| v)? ?1 1", 4, 0.95),
    ("cddl", "common development", "common development and distribution licen[sc]e", 1, 0.6),
    ("cpl-1", "common public", "common public licen[sc]e( version| v)? ?1( 0)?", 4, 1.0),
    ("cpal-1", "common public attribution", "common public attribution licen[sc]e( version| v)? ?1( 0)?", 4, 1.0),
    ("ipl-1", "ibm public", "ibm public licen[sc]e( version| v)? ?1( 0)?", 4, 1.0),
    ("osl-3", "open software", "open software licen[sc]e( version| v)? ?3( 0)?", 4, 1.0),
    ("osl-2.1", "open software", "open software licen[sc]e( version| v)? ?2 1", 4, 1.0),
    ("afl-3", "academic free", "academic free licen[sc]e( version| v)? ?3( 0)?", 4, 1.0),
    ("afl-2.1", "academic free", "academic free licen[sc]e( version| v)? ?2 1", 4, 1.0),
    ("eupl-1.1", "european union public", "european union public licen[sc]e( version| v)? ?1 1", 4, 1.0),
    ("eupl-1.2", "european union public", "european union public licen[sc]e( version| v)? ?1 2", 4, 1.0),
    ("eupl-1.2", "eupl", "spdx license identifier eupl 1 2", 4, 1.0),
    ("eupl", "eupl", "licen[sc]ed under the eupl", 2, 0.7),
    ("cecill-2.1", "cecill", "cecill( free software licen[sc]e agreement)?( version| v)? ?2 1", 4, 1.0),
    ("cecill-b", "cecill", "cecill b( licen[sc]e)?", 3, 0.9),
    ("cecill-c", "cecill", "cecill c( licen[sc]e)?", 3, 0.9),
    ("ms-pl", "microsoft public", "microsoft public licen[sc]e", 3, 0.9),
    ("ms-pl", "ms pl", "spdx license identifier ms pl", 4, 1.0),
    ("ms-rl", "microsoft reciprocal", "microsoft reciprocal licen[sc]e", 3, 0.9),
    ("apsl-2", "apple public", "apple public source licen[sc]e( version| v)? ?2( 0)?", 4, 1.0),
    ("sissl", "sun industry", "sun industry standards source licen[sc]e", 3, 0.9),
    ("qpl-1", "q public", "q public licen[sc]e( version| v)?( 1 0)?", 4, 0.95),
    ("rpl-1.5", "reciprocal public", "reciprocal public licen[sc]e( version| v)? ?1 5", 4, 1.0),
    ("sleepycat", "sleepycat", "sleepycat licen[sc]e", 3, 0.9),
    ("watcom-1", "watcom", "sybase open watcom public licen[sc]e( version| v)?( 1 0)?", 4, 0.95),
    ("nasa-1.3", "nasa open", "nasa open source agreement( version| v)? ?1 3", 4, 1.0),
    ("lppl-1.3c", "latex project", "latex project public licen[sc]e( version| v)? ?1 3 ?c", 4, 1.0),
    ("lppl", "latex project", "latex project public licen[sc]e", 2, 0.7),
    ("erlpl-1.1", "erlang public", "erlang public licen[sc]e( version| v)?( 1 1)?", 4, 0.9),
    # permissive, others
    ("isc", "ed under", "licen[sc]ed under (the )?(terms of )?(the )?isc( licen[sc]e)?", 3, 1.0),
    ("isc", "isc licen", "isc licen[sc]e", 2, 0.7),
    ("isc", "identifier isc", "spdx license identifier isc", 4, 1.0),
    ("isc", "permission to use", "permission to use copy modify and or distribute this software for any purpose", 4, 1.0),
    ("hpnd", "permission to use", "permission to use copy modify and distribute this software and its documentation for any purpose", 4, 0.95),
    ("zlib", "zlib", "zlib( libpng)? licen[sc]e", 3, 0.9),
    ("zlib", "zlib", "spdx license identifier zlib", 4, 1.0),
    ("zlib", "misrepresented", "the origin of this software must not be misrepresented", 4, 0.95),
    ("zlib", "altered source", "altered source versions must be plainly marked as such", 4, 0.95),
    ("libpng", "libpng", "libpng licen[sc]e", 2, 0.8),
    ("boost-1", "boost", "boost software licen[sc]e( version| v)?( 1 0)?", 4, 1.0),
    ("boost-1", "bsl", "spdx license identifier bsl 1 0", 4, 1.0),
    ("artistic-1", "artistic", "artistic licen[sc]e( version| v)? ?1( 0)?", 4, 1.0),
    ("artistic-2", "artistic", "artistic licen[sc]e( version| v)? ?2( 0)?", 4, 1.0),
    ("artistic-2", "artistic", "spdx license identifier artistic 2 0", 4, 1.0),
    ("artistic", "artistic", "(the )?artistic licen[sc]e", 1, 0.6),
    ("perl", "perl", "(under )?the same terms as perl( itself)?", 3, 0.8),
    ("ruby", "ruby", "under the same terms as ruby", 3, 0.8),
    ("python-2", "python", "python software foundation licen[sc]e( version| v)?( 2)?", 4, 1.0),
    ("python-2", "psf", "spdx license identifier psf 2 0", 4, 1.0),
    ("python-2", "python", "spdx license identifier python 2 0", 4, 1.0),
    ("php-3.01", "php", "php licen[sc]e( version| v)? ?3 01", 4, 1.0),
    ("php-3", "php", "php licen[sc]e( version| v)? ?3 0", 3, 1.0),
    ("postgresql", "postgresql", "postgresql licen[sc]e", 3, 0.9),
    ("postgresql", "postgresql", "spdx license identifier postgresql", 4, 1.0),
    ("openssl", "openssl", "openssl licen[sc]e", 3, 0.9),
    ("openssl", "openssl toolkit", "this product includes software developed by the openssl project for use in the openssl toolkit", 4, 0.95),
    ("curl", "curl", "curl licen[sc]e", 3, 0.8),
    ("ftl", "freetype", "freetype (project )?licen[sc]e", 3, 0.9),
    ("ijg", "independent jpeg", "this software is based in part on the work of the independent jpeg group", 4, 0.95),
    ("icu", "icu licen", "icu licen[sc]e", 2, 0.8),
    ("unicode", "unicode", "unicode (data files and software|terms of use|licen[sc]e agreement data files)", 3, 0.8),
    ("unicode-3", "unicode", "unicode licen[sc]e v3", 4, 0.95),
    ("w3c", "w3c", "w3c software (notice and )?licen[sc]e", 3, 0.9),
    ("ncsa", "ncsa", "(university of illinois )?ncsa open source licen[sc]e", 3, 0.95),
    ("ncsa", "ncsa", "spdx license identifier ncsa", 4, 1.0),
    ("upl-1", "universal permissive", "universal permissive licen[sc]e( version| v)?( 1 0)?", 4, 1.0),
    ("ecl-2", "educational community", "educational community licen[sc]e( version| v)?( 2 0)?", 4, 1.0),
    ("blueoak-1", "blue oak", "blue oak model licen[sc]e( version)?( 1 0 0)?", 4, 1.0),
    ("mulan-2", "mulan", "mulan (psl|permissive software licen[sc]e)( version| v)? ?2", 4, 1.0),
    ("ntp", "ntp licen", "ntp licen[sc]e", 2, 0.7),
    ("vim", "vim licen", "vim licen[sc]e", 2, 0.8),
    ("tcl", "tcl", "tcl tk licen[sc]e", 2, 0.8),
    ("zpl-2.1", "zope", "zope public licen[sc]e( version| v)? ?2 1", 4, 1.0),
    ("beerware", "beer ware", "(the )?beer ware licen[sc]e", 3, 0.9),
    ("beerware", "me a beer", "you can buy me a beer in return", 4, 0.9),
    ("wtfpl", "wtfpl", "wtfpl( version| v)?( 2)?", 3, 0.9),
    ("wtfpl", "what the fuck", "do what the fuck you want to public licen[sc]e", 4, 1.0),
    ("unlicense", "unlicense", "(the )?unlicense", 2, 0.9),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain", 5, 1.0),
    ("json", "not evil", "(the )?software shall be used for good not evil", 4, 1.0),
    # Creative Commons
    ("cc0", "cc0", "cc0( 1 0)?( universal)?", 3, 0.9),
    ("cc0", "creative commons zero", "creative commons zero( (version|v) ?1 0)?( universal)?", 4, 0.95),
    ("cc0", "zero 1 0", "creativecommons org publicdomain zero 1 0", 4, 1.0),
    ("cc0", "cc0", "spdx license identifier cc0 1 0", 4, 1.0),
    ("cc-pdm", "domain mark", "public domain mark( 1 0)?", 4, 0.95),
    ("cc-by", "cc by", "cc by( [1-4] [05])?", 1, 0.8),
    ("cc-by-sa", "cc by sa", "cc by sa( [1-4] [05])?", 2, 0.8),
    ("cc-by-nd", "cc by nd", "cc by nd( [1-4] [05])?", 2, 0.8),
    ("cc-by-nc", "cc by nc", "cc by nc( [1-4] [05])?", 2, 0.8),
    ("cc-by-nc-sa", "cc by nc sa", "cc by nc sa( [1-4] [05])?", 3, 0.8),
    ("cc-by-nc-nd", "cc by nc nd", "cc by nc nd( [1-4] [05])?", 3, 0.8),
    ("cc-by", "cc by", "licen[sc]ed under (a |the )?cc by( [1-4] [05])?( licen[sc]e)?", 2, 1.0),
    ("cc-by-sa", "cc by sa", "licen[sc]ed under (a |the )?cc by sa( [1-4] [05])?( licen[sc]e)?", 3, 1.0),
    ("cc-by-nd", "cc by nd", "licen[sc]ed under (a |the )?cc by nd( [1-4] [05])?( licen[sc]e)?", 3, 1.0),
    ("cc-by-nc", "cc by nc", "licen[sc]ed under (a |the )?cc by nc( [1-4] [05])?( licen[sc]e)?", 3, 1.0),
    ("cc-by-nc-sa", "cc by nc sa", "licen[sc]ed under (a |the )?cc by nc sa( [1-4] [05])?( licen[sc]e)?", 4, 1.0),
    ("cc-by-nc-nd", "cc by nc nd", "licen[sc]ed under (a |the )?cc by nc nd( [1-4] [05])?( licen[sc]e)?", 4, 1.0),
    ("cc-by", "creative commons", "creative commons attribution( [1-4] [05])?( international| unported| generic)?", 2, 0.9),
    ("cc-by-sa", "creative commons", "creative commons attribution share ?alike( [1-4] [05])?", 4, 0.95),
    ("cc-by-nd", "creative commons", "creative commons attribution no ?deriv(s|atives)( [1-4] [05])?", 4, 0.95),
    ("cc-by-nc", "creative commons", "creative commons attribution non ?commercial( [1-4] [05])?", 4, 0.95),
    ("cc-by-nc-sa", "creative commons", "creative commons attribution non ?commercial share ?alike( [1-4] [05])?", 5, 0.95),
    ("cc-by-nc-nd", "creative commons", "creative commons attribution non ?commercial no ?deriv(s|atives)( [1-4] [05])?", 5, 0.95),
    ("cc-by", "licenses by", "creativecommons org licenses by( [1-4] [05])?", 3, 0.95),
    ("cc-by-sa", "licenses by sa", "creativecommons org licenses by sa( [1-4] [05])?", 4, 0.95),
    ("cc-by-nd", "licenses by nd", "creativecommons org licenses by nd( [1-4] [05])?", 4, 0.95),
    ("cc-by-nc", "licenses by nc", "creativecommons org licenses by nc( [1-4] [05])?", 4, 0.95),
    ("cc-by-nc-sa", "licenses by nc sa", "creativecommons org licenses by nc sa( [1-4] [05])?", 5, 0.95),
    ("cc-by-nc-nd", "licenses by nc nd", "creativecommons org licenses by nc nd( [1-4] [05])?", 5, 0.95),
    ("cc", "creative commons", "(under a )?creative commons licen[sc]e", 1, 0.6),
    # data, fonts and models
    ("odbl-1", "odbl", "odbl( version| v)?( 1 0)?", 3, 0.9),
    ("odbl-1", "open database", "open database licen[sc]e( odbl)?( version| v)?( 1 0)?", 4, 1.0),
    ("odc-by-1", "open data commons", "open data commons attribution licen[sc]e( version| v)?( 1 0)?", 4, 1.0),
    ("pddl-1", "open data commons", "open data commons public domain dedication (and|&) licen[sc]e", 4, 1.0),
    ("cdla-permissive-2", "community data", "community data licen[sc]e agreement permissive( version| v)?( 2 0)?", 4, 0.95),
    ("cdla-sharing-1", "community data", "community data licen[sc]e agreement sharing( version| v)?( 1 0)?", 4, 0.95),
    ("ogl-uk-3", "open government", "open government licen[sc]e (version|v) ?3( 0)?", 4, 1.0),
    ("ogl-uk", "open government", "open government licen[sc]e", 2, 0.7),
    ("etalab-2", "licence ouverte", "licence ouverte( version| v)?( 2 0)?", 3, 0.9),
    ("dl-de-by-2", "datenlizenz", "datenlizenz deutschland namensnennung( version)?( 2 0)?", 4, 0.95),
    ("ofl-1.1", "open font", "(sil )?open font licen[sc]e( version| v)?( 1 1)?", 4, 1.0),
    ("ofl-1.1", "identifier ofl", "spdx license identifier ofl 1 1", 4, 1.0),
    ("ofl-1.1", "sil org", "scripts sil org ofl", 4, 0.95),
    ("bitstream-vera", "bitstream vera", "bitstream vera (is a trademark|fonts copyright)", 3, 0.9),
    ("ubuntu-font-1", "ubuntu font", "ubuntu font licen[sc]e( version| v)?( 1 0)?", 4, 0.95),
    ("openrail", "rail", "(bigscience |creativeml )?open rail( m| s)? licen[sc]e", 3, 0.9),
    ("openrail", "openrail", "(bigscience |creativeml )?openrail( m| s)?( licen[sc]e)?", 3, 0.9),
    ("llama-community", "community license", "llama [1-4]( [0-9])? community license agreement", 4, 0.95),
    ("gemma", "gemma", "gemma terms of use", 3, 0.9),
    # source available and proprietary
    ("busl-1.1", "business source", "business source licen[sc]e( version| v)?( 1 1)?", 4, 1.0),
    ("busl-1.1", "busl", "spdx license identifier busl 1 1", 4, 1.0),
    ("sspl-1", "server side", "server side public licen[sc]e( version| v)?( 1)?", 4, 1.0),
    ("elastic-2", "elastic", "elastic licen[sc]e( version| v)? ?2( 0)?", 4, 1.0),
    ("commons-clause", "commons clause", "commons clause (licen[sc]e )?(condition|restriction)", 3, 0.9),
    ("polyform-nc-1", "polyform", "polyform noncommercial licen[sc]e( 1 0 0)?", 4, 0.95),
    ("polyform-sb-1", "polyform", "polyform small business licen[sc]e( 1 0 0)?", 4, 0.95),
    ("parity-7", "parity", "parity public licen[sc]e( 7 0 0)?", 4, 0.95),
    ("public-domain", "domain", "(dedicated to|released into|placed in|in) the public domain", 3, 0.8),
    ("public-domain", "no copyright", "no copyright is claimed", 2, 0.6),
    ("all-rights-reserved", "rights reserved", "all rights reserved", 3, 0.6),
    ("all-rights-reserved", "tous droits", "tous droits réservés", 3, 0.6),
    ("all-rights-reserved", "alle rechte", "alle rechte vorbehalten", 3, 0.6),
    ("all-rights-reserved", "todos los derechos", "todos los derechos reservados", 3, 0.6),
    ("proprietary", "proprietary", "confidential and proprietary", 3, 0.7),
    ("proprietary", "proprietary", "proprietary and confidential", 3, 0.7),
    ("proprietary", "unauthorized copying", "unauthorized copying of this file via any medium is strictly prohibited", 4, 0.9),
    ("proprietary", "trade secret", "contains trade secrets? (and proprietary information )?of", 3, 0.7),
    ("proprietary", "not for redistribution", "(internal use only )?not for redistribution", 2, 0.6),
    ("commercial", "commercial licen", "commercial licen[sc]e (is )?(available|required)", 2, 0.6),
    ("non-commercial", "non commercial", "for non commercial (use|purposes) only", 3, 0.7),
    ("non-commercial", "personal use", "for personal use only", 2, 0.6),
    ("academic", "academic", "for academic (and research |or research )?(use|purposes) only", 3, 0.7),
)
