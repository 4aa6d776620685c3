"""Texts, headers and notices of public licences, by their SPDX name.

Fixed values: the words are those of the licences.  Short licences are given whole,
long ones by their title and the header that they ask files to bear; what only
their names tell apart is made by rule.
"""

from __future__ import annotations

AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    + AS_IS
    + "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, "
    "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE "
    "OR OTHER DEALINGS IN THE SOFTWARE."
)
BSD_OPENING = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
)
BSD_CLAUSES = (
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution. "
)
BSD_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission. "
)
BSD_DISCLAIMER = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE '
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE "
    "LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
    "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
    "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
ISC_WARRANTY = (
    ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
    "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
APACHE_HEADER = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy "
    "of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the "
    'License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific '
    "language governing permissions and limitations under the License."
)
ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from "
    "the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and "
    "redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you "
    "wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not "
    "required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may "
    "not be removed or altered from any source distribution."
)
BOOST = (
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by "
    "this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the "
    "Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software "
    "and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the "
    "Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of "
    "machine-executable object code generated by a source language processor. "
    + AS_IS
    + "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE "
    "SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE "
    "OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this "
    "software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that "
    "recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make "
    "this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of "
    "relinquishment in perpetuity of all present and future rights to this software under copyright law."
)
WTFPL = (
    "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO."
)
MPL_HEADER = (
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can "
    "obtain one at https://mozilla.org/MPL/2.0/."
)


def _gnu(what: str, name: str, version: str) -> str:
    """The header of the three licences of the Free Software Foundation."""
    return (
        f"This {what} is free software; you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software "
        f"Foundation; either version {version} of the License, or (at your option) any later version. This {what} is distributed in the hope that it will "
        f"be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} "
        "for more details."
    )


def _creative(short: str, title: str) -> tuple[str, ...]:
    return (
        f"Licensed under CC {short}.",
        f"Creative Commons {title} International",
        f"This work is licensed under a Creative Commons {title} International License.",
        f"Creative Commons {title} International Public License",
    )


TEMPLATES: dict[str, tuple[str, ...]] = {
    "0BSD": (
        "BSD Zero Clause License",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted." + ISC_WARRANTY,
    ),
    "AGPL-3.0": (
        "GNU Affero General Public License Version 3, 19 November 2007",
        "This work is licensed under the GNU Affero General Public License, version 3.",
        _gnu("program", "Affero General Public License", "3"),
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Apache License Version 2.0, January 2004",
        APACHE_HEADER,
    ),
    "Artistic-2.0": (
        "The Artistic License 2.0",
        "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. This license establishes the "
        "terms under which a given free software Package may be copied, modified, distributed, and/or redistributed.",
    ),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License", f"{BSD_OPENING}: {BSD_CLAUSES}{BSD_DISCLAIMER}"),
    "BSD-3-Clause": (
        "Use of this source code is governed by a BSD-style license.",
        "BSD 3-Clause License",
        "New BSD License",
        BSD_OPENING,
        BSD_THIRD,
        f"{BSD_OPENING}: {BSD_CLAUSES}{BSD_THIRD}{BSD_DISCLAIMER}",
    ),
    "BSL-1.0": ("Boost Software License - Version 1.0 - August 17th, 2003", "Distributed under the Boost Software License, Version 1.0.", BOOST),
    "CC-BY-4.0": _creative("BY 4.0", "Attribution 4.0"),
    "CC-BY-NC-4.0": _creative("BY-NC 4.0", "Attribution-NonCommercial 4.0"),
    "CC-BY-ND-4.0": _creative("BY-ND 4.0", "Attribution-NoDerivatives 4.0"),
    "CC-BY-SA-4.0": _creative("BY-SA 4.0", "Attribution-ShareAlike 4.0"),
    "CC0-1.0": (
        "CC0 1.0 Universal",
        "Creative Commons Legal Code CC0 1.0 Universal",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ),
    "CDDL-1.0": (
        "Common Development and Distribution License (CDDL) Version 1.0",
        "The contents of this file are subject to the terms of the Common Development and Distribution License (the License). You may not use this file "
        "except in compliance with the License.",
    ),
    "EPL-2.0": (
        "Eclipse Public License - v 2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at "
        "https://www.eclipse.org/legal/epl-2.0/",
    ),
    "EUPL-1.2": ("European Union Public Licence v. 1.2", "Licensed under the EUPL, Version 1.2 or later"),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "GNU General Public License Version 2, June 1991",
        _gnu("program", "General Public License", "2"),
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "GNU General Public License Version 3, 29 June 2007",
        _gnu("program", "General Public License", "3"),
    ),
    "ISC": (
        "ISC License",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies." + ISC_WARRANTY,
    ),
    "LGPL-2.1": (
        "GNU Lesser General Public License Version 2.1, February 1999",
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        _gnu("library", "Lesser General Public License", "2.1"),
    ),
    "LGPL-3.0": (
        "GNU Lesser General Public License Version 3, 29 June 2007",
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        _gnu("library", "Lesser General Public License", "3"),
    ),
    "MIT": (
        "Released under the MIT License.",
        "MIT License",
        "The MIT License (MIT)",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        MIT,
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Mozilla Public License Version 2.0",
        MPL_HEADER,
    ),
    "OFL-1.1": (
        "SIL Open Font License Version 1.1 - 26 February 2007",
        "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    ),
    "Unlicense": ("This is free and unencumbered software released into the public domain.", UNLICENSE),
    "WTFPL": ("Do What The Fuck You Want To Public License", WTFPL),
    "Zlib": ("zlib License", ZLIB),
}
#: Every file may bear the name alone; those of the GNU licences say what of later versions.
for _name in TEMPLATES:
    _forms = ("", "-only", "-or-later") if "GPL" in _name else ("",)
    TEMPLATES[_name] += tuple(f"SPDX-License-Identifier: {_name}{form}" for form in _forms)
