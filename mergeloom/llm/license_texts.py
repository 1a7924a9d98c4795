"""Notices and passages by which licences are known."""

from __future__ import annotations

from typing import NamedTuple


class Template(NamedTuple):
    """A passage in lower-cased words; key, a part of it, must stand whole in a text."""

    label: str
    text: str
    key: str


#: Short notices, then passages of the licences themselves.
TEMPLATES = (
    Template("mit", "released under the mit license", "mit license"),
    Template("apache", "licensed under the apache license version 2 0", "apache license"),
    Template("gpl", "this work is licensed under the gnu general public license version 3", "general public license"),
    Template("gpl", "redistribute it and or modify it under the terms of the gnu general public license", "general public license"),
    Template("lgpl", "under the terms of the gnu lesser general public license", "lesser general public license"),
    Template("agpl", "under the terms of the gnu affero general public license", "affero general public license"),
    Template("mpl", "subject to the terms of the mozilla public license version 2 0", "mozilla public license"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial"),
    Template("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike"),
    Template("cc-by", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4"),
    Template("cc0", "dedicated to the public domain under cc0 1 0 universal", "cc0 1 0"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "hereby granted free of charge"),
    Template(
        "mit",
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
        "use copy modify merge publish distribute sublicense",
    ),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    Template(
        "bsd",
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        "binary form must reproduce the above copyright notice",
    ),
    Template(
        "bsd",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "endorse or promote products derived from this software",
    ),
    Template(
        "apache",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
        "see the license for the specific language governing permissions and limitations under the license",
        "specific language governing permissions and limitations",
    ),
    Template(
        "apache",
        "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense "
        "and distribute the work and such derivative works in source or object form",
        "sublicense and distribute the work and such derivative works",
    ),
    Template(
        "gpl",
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
        "see the gnu general public license for more details",
    ),
    Template(
        "gpl",
        "the gnu general public license is a free copyleft license for software and other kinds of works the licenses for most software and other practical works are designed to take away your freedom to share and change the works",
        "designed to take away your freedom to share",
    ),
    Template(
        "lgpl",
        "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu lesser general public license for more details",
        "see the gnu lesser general public license for more details",
    ),
    Template(
        "agpl",
        "the gnu affero general public license is a free copyleft license for software and other kinds of works specifically designed to ensure cooperation with the community in the case of network server software",
        "cooperation with the community in the case of network server software",
    ),
    Template(
        "mpl",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
        "a copy of the mpl was not distributed with this file",
    ),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "distribute this software for any purpose"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
    Template(
        "unlicense",
        "in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain",
        "dedicate any and all copyright interest in the software",
    ),
    Template(
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software",
        "in no event will the authors be held liable",
    ),
    Template("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software", "must not be misrepresented as being the original software"),
    Template("bsl", "boost software license version 1 0 august 17th 2003", "boost software license"),
    Template("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", "eclipse public license"),
    Template(
        "cc0",
        "to the extent possible under law the person who associated cc0 with this work has waived all copyright and related or neighboring rights to this work",
        "waived all copyright and related or neighboring rights",
    ),
    Template("wtfpl", "do what the fuck you want to public license version 2 december 2004", "what the fuck you want to"),
)
