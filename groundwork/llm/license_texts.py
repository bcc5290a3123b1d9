"""Licence texts and notices as (label, text, phrases): the phrases must stand within the text's place.

The texts are public legal texts and stand as they are published; their words are what counts. Short
notices and identifiers are made by rule from names.
"""

from __future__ import annotations

# fixed values: texts of licences and of the notices that they ask for
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or
substantial portions of the Software."""
MIT_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR
PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD_3_CLAUSE = """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""
ZERO_BSD = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES"""
APACHE_2 = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
APACHE_2_GRANT = """Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free,
irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form."""
GPL = """This program is free software{colon} you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation, either version {version} of the License, or
(at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
See the GNU {kind}General Public License for more details."""
GPL_PREAMBLE = """GNU GENERAL PUBLIC LICENSE Version {version} Copyright (C) Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."""
MPL_2 = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
EPL = """This program and the accompanying materials are made available under the terms of the Eclipse Public License v{version} which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v{version}"""
CDDL = """The contents of this file are subject to the terms of the Common Development and Distribution License (the License). You may not use this file except in compliance with the License."""
BOOST = """Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation
covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software"""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone
to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented"""
UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary,
for any purpose, commercial or non-commercial, and by any means."""
WTFPL = """DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE Version 2 Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed."""
CC0 = """To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."""
CC = """This work is licensed under a Creative Commons {name} {version} International License."""
CC_LINK = """creativecommons.org/licenses/{short}/{version}"""
OFL = """This Font Software is licensed under the SIL Open Font License, Version 1.1. This license is copied below, and is also available with a FAQ at https://scripts.sil.org/OFL"""
ARTISTIC_2 = """This program is free software; you can redistribute it and/or modify it under the terms of the Artistic License (2.0)."""
EUPL = """Licensed under the EUPL, Version 1.2 or as soon they will be approved by the European Commission subsequent versions of the EUPL"""

#: label: names by which short notices call a licence.
NAMES: dict[str, tuple[str, ...]] = {
    "mit": ("MIT License", "Expat License"), "apache-2": ("Apache License 2.0", "Apache License, Version 2.0", "Apache 2.0 license", "Apache Software License 2.0"), "bsd-2": ("BSD 2-Clause License", "Simplified BSD License", "2-clause BSD license"),
    "bsd-3": ("BSD 3-Clause License", "New BSD License", "Modified BSD License", "3-clause BSD license"), "isc": ("ISC License",), "gpl-2": ("GNU General Public License version 2", "GNU GPL v2", "GPLv2", "GPL version 2"),
    "gpl-3": ("GNU General Public License version 3", "GNU General Public License v3.0", "GNU GPL v3", "GPLv3", "GPL version 3"), "lgpl-2.1": ("GNU Lesser General Public License version 2.1", "LGPLv2.1"), "lgpl-3": ("GNU Lesser General Public License version 3", "LGPLv3"),
    "agpl-3": ("GNU Affero General Public License version 3", "AGPLv3", "GNU AGPL v3"), "mpl-2": ("Mozilla Public License 2.0", "Mozilla Public License, version 2.0", "MPL 2.0"), "epl-1": ("Eclipse Public License 1.0", "Eclipse Public License v1.0"),
    "epl-2": ("Eclipse Public License 2.0", "Eclipse Public License v2.0", "Eclipse Public License, version 2.0"), "cddl-1": ("Common Development and Distribution License", "CDDL 1.0"), "boost-1": ("Boost Software License, Version 1.0", "Boost Software License 1.0"), "zlib": ("zlib License",),
    "unlicense": ("Unlicense",), "wtfpl": ("WTFPL",), "artistic-2": ("Artistic License 2.0",), "ofl-1.1": ("SIL Open Font License 1.1", "SIL Open Font License, Version 1.1"), "eupl-1.2": ("European Union Public Licence 1.2", "EUPL 1.2"),
    "cc0": ("CC0 1.0", "CC0"),
}
LEADS = ("Licensed under the {}", "Released under the {}", "Distributed under the {}", "Published under the {}", "Available under the {}", "Under the terms of the {}", "License: {}", "{} applies to this")
#: label: identifiers of the public licence list.
IDENTIFIERS: dict[str, tuple[str, ...]] = {
    "mit": ("MIT",), "apache-2": ("Apache-2.0",), "bsd-2": ("BSD-2-Clause",), "bsd-3": ("BSD-3-Clause",), "isc": ("ISC",), "0bsd": ("0BSD",), "gpl-2": ("GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later"), "gpl-3": ("GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later"),
    "lgpl-2.1": ("LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later"), "lgpl-3": ("LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later"), "agpl-3": ("AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later"), "mpl-2": ("MPL-2.0",), "epl-1": ("EPL-1.0",), "epl-2": ("EPL-2.0",),
    "cddl-1": ("CDDL-1.0",), "boost-1": ("BSL-1.0",), "zlib": ("Zlib",), "unlicense": ("Unlicense",), "wtfpl": ("WTFPL",), "artistic-2": ("Artistic-2.0",), "ofl-1.1": ("OFL-1.1",), "eupl-1.2": ("EUPL-1.2",), "cc0": ("CC0-1.0",),
}
#: short form: name of the Creative Commons licences.
CREATIVE_COMMONS = {
    "by": "Attribution", "by-sa": "Attribution-ShareAlike", "by-nc": "Attribution-NonCommercial", "by-nd": "Attribution-NoDerivatives", "by-nc-sa": "Attribution-NonCommercial-ShareAlike", "by-nc-nd": "Attribution-NonCommercial-NoDerivatives",
}


def templates() -> list[tuple[str, str, tuple[str, ...]]]:
    """All templates; a phrase is given by its words, as they stand in the text."""
    out = [
        ("mit", MIT, ("permission is hereby granted free of charge", "to deal in the software")), ("mit", MIT_WARRANTY, ("noninfringement", "dealings in the software")),
        ("bsd-2", BSD_2, ("redistribution and use in source and binary forms",)), ("bsd-3", f"{BSD_2} {BSD_3_CLAUSE}", ("redistribution and use in source and binary forms", "endorse or promote products")), ("bsd-3", BSD_3_CLAUSE, ("endorse or promote products",)),
        ("isc", ISC, ("with or without fee is hereby granted", "provided that the above copyright notice")), ("0bsd", ZERO_BSD, ("with or without fee is hereby granted the software",)),
        ("apache-2", APACHE_2, ("apache license version 2 0",)), ("apache-2", APACHE_2_GRANT, ("prepare derivative works of", "royalty free irrevocable copyright license")),
        *[(f"{short}-{v.split('.')[0] if v != '2.1' else v}", GPL.format(kind=kind, version=v, colon=c), (f"gnu {kind.lower()}general public license".replace("  ", " "), f"version {v}".replace(".", " ")))
          for short, kind, v, c in (("gpl", "", "2", ";"), ("gpl", "", "3", ":"), ("lgpl", "Lesser ", "2.1", ";"), ("lgpl", "Lesser ", "3", ":"), ("agpl", "Affero ", "3", ":"))],
        ("gpl-2", GPL_PREAMBLE.format(version="2"), ("gnu general public license version 2",)), ("gpl-3", GPL_PREAMBLE.format(version="3"), ("gnu general public license version 3",)),
        ("mpl-2", MPL_2, ("mozilla public license v 2 0",)), ("epl-1", EPL.format(version="1.0"), ("eclipse public license", "v1 0")), ("epl-2", EPL.format(version="2.0"), ("eclipse public license", "v2 0")),
        ("cddl-1", CDDL, ("common development and distribution license",)), ("boost-1", BOOST, ("boost software license",)), ("zlib", ZLIB, ("must not be misrepresented",)), ("unlicense", UNLICENSE, ("unencumbered software", "public domain")),
        ("wtfpl", WTFPL, ("you want to public license",)), ("cc0", CC0, ("waived all copyright",)), ("ofl-1.1", OFL, ("sil open font license",)), ("artistic-2", ARTISTIC_2, ("artistic license",)), ("eupl-1.2", EUPL, ("eupl version 1 2",)),
    ]
    for short, name in CREATIVE_COMMONS.items():
        for v in ("3.0", "4.0"):
            label, plain = f"cc-{short}", v.replace(".", " ")
            out += [(label, CC.format(name=name, version=v), (f"{name.lower()} {v}",)), (label, CC_LINK.format(short=short, version=v), (f"licenses {short} {v}",)), (label, f"SPDX-License-Identifier: CC-{short}-{v}", (f"identifier cc {short} {plain}",))]
            out += [(label, lead.format(f"CC {short.upper()} {v}"), (f"cc {short} {v}",)) for lead in LEADS] + [(label, lead.format(f"Creative Commons {name} {v}"), (f"{name} {v}",)) for lead in LEADS]
    for label, names in NAMES.items():
        out += [(label, lead.format(name), (name,)) for name in names for lead in LEADS]
    for label, names in IDENTIFIERS.items():
        out += [(label, f"SPDX-License-Identifier: {x}", (f"identifier {x}",)) for x in names]
    return out
