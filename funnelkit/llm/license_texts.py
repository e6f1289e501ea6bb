"""Public licence notices, (licence, form, text). The licence is its SPDX name."""

TEMPLATES: tuple[tuple[str, str, str], ...] = (
    ("Apache-2.0", "line", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "header", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file
        except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
        distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
        either express or implied. See the License for the specific language governing permissions and limitations
        under the License."""),
    ("MIT", "line", "Released under the MIT License."),
    ("MIT", "line", "Licensed under the MIT License."),
    ("MIT", "text", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction, including without
        limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
        Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or substantial portions of
        the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT
        NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""),
    ("BSD-2-Clause", "text", """Redistribution and use in source and binary forms, with or without modification, are permitted
        provided that the following conditions are met: Redistributions of source code must retain the above copyright
        notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the
        above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
        materials provided with the distribution."""),
    ("BSD-3-Clause", "text", """Neither the name of the copyright holder nor the names of its contributors may be used to
        endorse or promote products derived from this software without specific prior written permission."""),
    ("GPL-2.0", "line", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "line", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "header", """This program is free software: you can redistribute it and/or modify it under the terms of the
        GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at
        your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY
        WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU
        General Public License for more details."""),
    ("GPL-2.0", "header", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation; either version 2 of the License, or
        (at your option) any later version. This program is distributed in the hope that it will be useful, but
        WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
        PURPOSE. See the GNU General Public License for more details."""),
    ("LGPL-2.1", "header", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU
        Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the
        License, or (at your option) any later version. This library is distributed in the hope that it will be
        useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A
        PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."""),
    ("LGPL-3.0", "header", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        Lesser General Public License as published by the Free Software Foundation, either version 3 of the
        License, or (at your option) any later version. This program is distributed in the hope that it will be
        useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A
        PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."""),
    ("AGPL-3.0", "header", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        Affero General Public License as published by the Free Software Foundation, either version 3 of the
        License, or (at your option) any later version. This program is distributed in the hope that it will be
        useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A
        PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."""),
    ("LGPL-3.0", "line", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "line", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "header", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy
        of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
    ("ISC", "text", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee
        is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""),
    ("Zlib", "text", """This software is provided 'as-is', without any express or implied warranty. In no event will the
        authors be held liable for any damages arising from the use of this software."""),
    ("Unlicense", "text", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "line", "This work is dedicated to the public domain under CC0 1.0."),
    ("CC-BY-4.0", "line", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "line", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "line", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "line", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "line", "Licensed under CC BY-ND 4.0."),
    ("LicenseRef-Proprietary", "line", "All rights reserved."),
)

#: Words that tell a notice from the ones like it: each of these runs must be in the text as it stands.
TELLING: dict[tuple[str, str], tuple[str, ...]] = {
    ("Apache-2.0", "line"): ("Apache License, Version 2.0",),
    ("Apache-2.0", "header"): ("Apache License, Version 2.0",),
    ("MIT", "line"): ("MIT License",),
    ("GPL-2.0", "line"): ("the GNU General Public License", "version 2"),
    ("GPL-3.0", "line"): ("the GNU General Public License", "version 3"),
    ("LGPL-3.0", "line"): ("GNU Lesser General Public License", "version 3"),
    ("AGPL-3.0", "line"): ("GNU Affero General Public License", "version 3"),
    ("GPL-2.0", "header"): ("terms of the GNU General Public License", "version 2"),
    ("GPL-3.0", "header"): ("terms of the GNU General Public License", "version 3"),
    ("LGPL-2.1", "header"): ("terms of the GNU Lesser General Public License", "version 2.1"),
    ("LGPL-3.0", "header"): ("terms of the GNU Lesser General Public License", "version 3"),
    ("AGPL-3.0", "header"): ("terms of the GNU Affero General Public License", "version 3"),
    ("MPL-2.0", "header"): ("Mozilla Public License", "2.0"),
    ("CC0-1.0", "line"): ("CC0 1.0",),
    ("CC-BY-SA-4.0", "line"): ("CC BY-SA 4.0",),
    ("CC-BY-NC-4.0", "line"): ("CC BY-NC 4.0",),
    ("CC-BY-ND-4.0", "line"): ("CC BY-ND 4.0",),
}
