"""Licence notices by label, in words that a reader of such notices would look for. Published notices, abridged where long."""

#: label, notice
NOTICES = [
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "this project is licensed under the terms of the mit license"),
    ("mit", "spdx license identifier mit"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "apache license version 2 0 january 2004"),
    ("apache-2.0", "spdx license identifier apache 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("gpl-3.0", "licensed under the gnu general public license version 3"),
    ("gpl-3.0", "gnu general public license version 3 29 june 2007"),
    ("gpl-3.0", "spdx license identifier gpl 3 0"),
    ("gpl-2.0", "licensed under the gnu general public license version 2"),
    ("gpl-2.0", "gnu general public license version 2 june 1991"),
    ("gpl-2.0", "spdx license identifier gpl 2 0"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "licensed under the bsd license"),
    ("cc-by-4.0", "licensed under cc by 4 0"),
    ("cc-by-sa", "licensed under cc by sa"),
    ("cc-by-nc", "licensed under cc by nc"),
    ("cc-by-nd", "licensed under cc by nd"),
    ("cc-by", "this work is licensed under a creative commons attribution"),
    ("cc-by-sa", "creative commons attribution sharealike"),
    ("cc-by-nc", "creative commons attribution noncommercial"),
    ("cc0", "creative commons zero"),
    ("cc0", "cc0 1 0 universal public domain dedication"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
#: Phrases whose every place counts: phrase, label.
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
