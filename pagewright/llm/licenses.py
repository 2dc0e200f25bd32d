"""License scans by ordered signature rules.

A rule is a regular expression with a license, a kind, a priority and a keyword that every match contains. Documents
are searched for the keywords first, all documents of a slice in one go and in any case; only the rules whose keyword
a document has are run on it, over the whole text. Detections are then resolved: they are taken by priority, then
length, then order of the rules, then place; one that lies within one taken before, or has one taken before within
it, is suppressed. Detections that overlap only in part both stay.

Rules are case-insensitive over ASCII; ``_`` in a pattern below stands for white space.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .buffers import flat, ship, slices, tidied

RESULT = "doc_id long, license_id string, rule_id string, kind string, start int, stop int, matched string"


class Rule(NamedTuple):
    rule_id: str
    license_id: str
    kind: str
    priority: int
    keyword: str
    pattern: str


#: license, its name in running text, its address (both patterns; the address may be missing)
_NAMES = r"""
Apache-1.0|Apache_(?:Software_)?Licen[sc]e,?_(?:Version_|v\.?_?)?1\.0\b|apache\.org/licenses/LICENSE-1\.0
Apache-1.1|Apache_(?:Software_)?Licen[sc]e,?_(?:Version_|v\.?_?)?1\.1\b|apache\.org/licenses/LICENSE-1\.1
Apache-2.0|Apache_(?:Software_)?Licen[sc]e,?_?\(?(?:Version_|v\.?_?)?2(?:\.0)?\b|apache\.org/licenses/LICENSE-2\.0
MIT|(?:the_)?(?:MIT|Expat)(?:_|-)(?:style_)?Licen[sc]e|opensource\.org/licen[sc]es?/mit\b
MIT-0|MIT_No_Attribution(?:_Licen[sc]e)?|opensource\.org/licen[sc]es?/mit-0\b
X11|X11_Licen[sc]e|x\.org/Downloads_terms
ISC|(?:the_)?ISC_Licen[sc]e|opensource\.org/licen[sc]es?/isc\b
0BSD|(?:Zero-Clause|0-clause)_BSD(?:_Licen[sc]e)?|opensource\.org/licen[sc]es?/0bsd\b
BSD-2-Clause|(?:Simplified|FreeBSD|2-clause|two-clause)_(?:BSD_)?Licen[sc]e|opensource\.org/licen[sc]es?/bsd-2-clause
BSD-2-Clause-alt|BSD_2-Clause(?:_"?Simplified"?)?_Licen[sc]e|
BSD-3-Clause|(?:New|Modified|Revised|3-clause|three-clause)_BSD_Licen[sc]e|opensource\.org/licen[sc]es?/bsd-3-clause
BSD-3-Clause-alt|BSD_3-Clause(?:_"?(?:New|Revised|New"?_or_"?Revised)"?)?_Licen[sc]e|
BSD-4-Clause|(?:Original|Old|4-clause|four-clause)_BSD_Licen[sc]e|directory\.fsf\.org/wiki/License:BSD_4Clause
BSD|(?:the_)?BSD(?:-style)?_Licen[sc]e|opensource\.org/licen[sc]es?/bsd-license
BSL-1.0|Boost_Software_Licen[sc]e(?:,?_(?:Version_)?1\.0)?|boost\.org/LICENSE_1_0\.txt
Zlib|(?:the_)?zlib(?:/libpng)?_Licen[sc]e|opensource\.org/licen[sc]es?/zlib
Libpng|libpng_Licen[sc]e|libpng\.org/pub/png/src/libpng-LICENSE\.txt
GPL-1.0|GNU_General_Public_Licen[sc]e,?_(?:as_published_by_the_Free_Software_Foundation[;,]?_)?(?:either_)?(?:version_|v\.?_?)1(?:\.0)?\b|gnu\.org/licenses/(?:old-licenses/)?gpl-1\.0
GPL-2.0|GNU_General_Public_Licen[sc]e,?_(?:as_published_by_the_Free_Software_Foundation[;,]?_)?(?:either_)?(?:version_|v\.?_?)2(?:\.0)?\b|gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0
GPL-3.0|GNU_General_Public_Licen[sc]e,?_(?:as_published_by_the_Free_Software_Foundation[;,]?_)?(?:either_)?(?:version_|v\.?_?)3(?:\.0)?\b|gnu\.org/licenses/gpl-3\.0
GPL|GNU_General_Public_Licen[sc]e|gnu\.org/(?:copyleft|licenses)/gpl\.
LGPL-2.0|GNU_(?:Library|Lesser)_General_Public_Licen[sc]e,?_(?:version_|v\.?_?)2(?:\.0)?\b(?!\.1)|gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.0
LGPL-2.1|GNU_Lesser_General_Public_Licen[sc]e,?_(?:version_|v\.?_?)2\.1\b|gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1
LGPL-3.0|GNU_Lesser_General_Public_Licen[sc]e,?_(?:version_|v\.?_?)3(?:\.0)?\b|gnu\.org/licenses/lgpl-3\.0
LGPL|GNU_(?:Library|Lesser)_General_Public_Licen[sc]e|gnu\.org/(?:copyleft/lesser|licenses/lgpl)\.
AGPL-1.0|Affero_General_Public_Licen[sc]e,?_(?:version_|v\.?_?)1(?:\.0)?\b|affero\.org/oagpl
AGPL-3.0|(?:GNU_)?Affero_General_Public_Licen[sc]e(?:,?_(?:version_|v\.?_?)3(?:\.0)?\b)?|gnu\.org/licenses/agpl
GFDL-1.1|GNU_Free_Documentation_Licen[sc]e,?_(?:version_|v\.?_?)1\.1\b|gnu\.org/licenses/(?:old-licenses/)?fdl-1\.1
GFDL-1.2|GNU_Free_Documentation_Licen[sc]e,?_(?:version_|v\.?_?)1\.2\b|gnu\.org/licenses/(?:old-licenses/)?fdl-1\.2
GFDL-1.3|GNU_Free_Documentation_Licen[sc]e,?_(?:version_|v\.?_?)1\.3\b|gnu\.org/licenses/fdl-1\.3
GFDL|GNU_Free_Documentation_Licen[sc]e|gnu\.org/(?:copyleft|licenses)/fdl\.
MPL-1.0|Mozilla_Public_Licen[sc]e,?_(?:version_|v\.?_?)1\.0\b|mozilla\.org/MPL/1\.0
MPL-1.1|Mozilla_Public_Licen[sc]e,?_(?:version_|v\.?_?)1\.1\b|mozilla\.org/MPL/1\.1
MPL-2.0|Mozilla_Public_Licen[sc]e,?_(?:version_|v\.?_?)2(?:\.0)?\b|mozilla\.org/(?:en-US/)?MPL/2\.0
MPL|Mozilla_Public_Licen[sc]e|mozilla\.org/(?:en-US/)?MPL/?(?=[\s"')]|$)
EPL-1.0|Eclipse_Public_Licen[sc]e,?_(?:-_)?(?:version_|v\.?_?)?1(?:\.0)?\b|eclipse\.org/legal/epl-v10
EPL-2.0|Eclipse_Public_Licen[sc]e,?_(?:-_)?(?:version_|v\.?_?)?2(?:\.0)?\b|eclipse\.org/legal/epl-(?:v20|2\.0)
EDL-1.0|Eclipse_Distribution_Licen[sc]e(?:,?_(?:version_|v\.?_?)?1\.0)?|eclipse\.org/org/documents/edl-v10
CPL-1.0|Common_Public_Licen[sc]e(?:,?_(?:version_|v\.?_?)?1\.0)?|opensource\.org/licen[sc]es?/cpl1\.0
IPL-1.0|IBM_Public_Licen[sc]e(?:,?_(?:version_|v\.?_?)?1\.0)?|opensource\.org/licen[sc]es?/ibmpl
CDDL-1.0|Common_Development_and_Distribution_Licen[sc]e,?_\(?(?:CDDL\)?,?_)?(?:version_|v\.?_?)?1\.0\b|opensource\.org/licen[sc]es?/cddl-?1
CDDL-1.1|Common_Development_and_Distribution_Licen[sc]e,?_\(?(?:CDDL\)?,?_)?(?:version_|v\.?_?)?1\.1\b|glassfish\.(?:java\.net|dev\.java\.net)/public/CDDL
CDDL|Common_Development_and_Distribution_Licen[sc]e|
EUPL-1.1|European_Union_Public_Licen[sc]e,?_(?:\(EUPL\)_)?(?:version_|v\.?_?)?1\.1\b|ec\.europa\.eu/idabc/eupl
EUPL-1.2|European_Union_Public_Licen[sc]e,?_(?:\(EUPL\)_)?(?:version_|v\.?_?)?1\.2\b|joinup\.ec\.europa\.eu/[^\s]*eupl
Artistic-1.0|Artistic_Licen[sc]e(?:_(?:version_|v\.?_?)?1\.0)?\b(?!_(?:version_|v\.?_?)?2)|opensource\.org/licen[sc]es?/artistic-license-1\.0
Artistic-2.0|Artistic_Licen[sc]e,?_(?:version_|v\.?_?)?2(?:\.0)?\b|opensource\.org/licen[sc]es?/artistic-license-2\.0
AFL-2.1|Academic_Free_Licen[sc]e,?_(?:version_|v\.?_?)?2\.1\b|opensource\.org/licen[sc]es?/afl-2\.1
AFL-3.0|Academic_Free_Licen[sc]e,?_(?:\(AFL\)_)?(?:version_|v\.?_?)?3(?:\.0)?\b|opensource\.org/licen[sc]es?/afl-3\.0
OSL-3.0|Open_Software_Licen[sc]e,?_(?:\(OSL\)_)?(?:version_|v\.?_?)?3(?:\.0)?\b|opensource\.org/licen[sc]es?/osl-3\.0
ECL-2.0|Educational_Community_Licen[sc]e(?:,?_(?:version_|v\.?_?)?2\.0)?|opensource\.org/licen[sc]es?/ecl-2\.0
MS-PL|Microsoft_Public_Licen[sc]e|opensource\.org/licen[sc]es?/ms-pl
MS-RL|Microsoft_Reciprocal_Licen[sc]e|opensource\.org/licen[sc]es?/ms-rl
NCSA|(?:University_of_Illinois/)?NCSA_Open_Source_Licen[sc]e|opensource\.org/licen[sc]es?/ncsa
PSF-2.0|(?:Python_Software_Foundation|PSF)_Licen[sc]e(?:_(?:version_|v\.?_?)?2)?|docs\.python\.org/[^\s]*license\.html
PHP-3.01|(?:the_)?PHP_Licen[sc]e,?_(?:version_|v\.?_?)3\.01\b|php\.net/license/3_01
PHP-3.0|(?:the_)?PHP_Licen[sc]e,?_(?:version_|v\.?_?)3\.0\b|php\.net/license/3_0\.
Ruby|Ruby_Licen[sc]e|ruby-lang\.org/[^\s]*LICENSE\.txt
Unlicense|(?:the_)?Unlicen[sc]e\b|unlicense\.org
WTFPL|(?:Do_What_The_F\S+_You_Want_To_Public_Licen[sc]e)|wtfpl\.net
Beerware|Beer-?ware_Licen[sc]e|people\.freebsd\.org/~phk
CC0-1.0|(?:Creative_Commons_)?CC0(?:_v?1\.0)?_(?:Universal_)?(?:Public_Domain_Dedication|Licen[sc]e)|creativecommons\.org/publicdomain/zero/1\.0
CC0-1.0-alt|Creative_Commons_Zero(?:_v?1\.0)?_(?:Universal_)?(?:Public_Domain_Dedication|Licen[sc]e)|
PDM-1.0|Creative_Commons_Public_Domain_Mark(?:_1\.0)?|creativecommons\.org/publicdomain/mark/1\.0
CC-BY-1.0|Creative_Commons_Attribution_1\.0\b|creativecommons\.org/licenses/by/1\.0
CC-BY-2.0|Creative_Commons_Attribution_2\.0\b|creativecommons\.org/licenses/by/2\.0
CC-BY-2.5|Creative_Commons_Attribution_2\.5\b|creativecommons\.org/licenses/by/2\.5
CC-BY-3.0|Creative_Commons_Attribution_3\.0\b|creativecommons\.org/licenses/by/3\.0
CC-BY-4.0|Creative_Commons_Attribution_4\.0\b|creativecommons\.org/licenses/by/4\.0
CC-BY-SA-2.0|Creative_Commons_Attribution[ -]Share_?Alike_2\.0\b|creativecommons\.org/licenses/by-sa/2\.0
CC-BY-SA-2.5|Creative_Commons_Attribution[ -]Share_?Alike_2\.5\b|creativecommons\.org/licenses/by-sa/2\.5
CC-BY-SA-3.0|Creative_Commons_Attribution[ -]Share_?Alike_3\.0\b|creativecommons\.org/licenses/by-sa/3\.0
CC-BY-SA-4.0|Creative_Commons_Attribution[ -]Share_?Alike_4\.0\b|creativecommons\.org/licenses/by-sa/4\.0
CC-BY-ND-3.0|Creative_Commons_Attribution[ -]No_?Deriv(?:ative)?s_3\.0\b|creativecommons\.org/licenses/by-nd/3\.0
CC-BY-ND-4.0|Creative_Commons_Attribution[ -]No_?Deriv(?:ative)?s_4\.0\b|creativecommons\.org/licenses/by-nd/4\.0
CC-BY-NC-2.0|Creative_Commons_Attribution[ -]Non-?Commercial_2\.0\b|creativecommons\.org/licenses/by-nc/2\.0
CC-BY-NC-3.0|Creative_Commons_Attribution[ -]Non-?Commercial_3\.0\b|creativecommons\.org/licenses/by-nc/3\.0
CC-BY-NC-4.0|Creative_Commons_Attribution[ -]Non-?Commercial_4\.0\b|creativecommons\.org/licenses/by-nc/4\.0
CC-BY-NC-SA-2.0|Creative_Commons_Attribution[ -]Non-?Commercial[ -]Share_?Alike_2\.0\b|creativecommons\.org/licenses/by-nc-sa/2\.0
CC-BY-NC-SA-3.0|Creative_Commons_Attribution[ -]Non-?Commercial[ -]Share_?Alike_3\.0\b|creativecommons\.org/licenses/by-nc-sa/3\.0
CC-BY-NC-SA-4.0|Creative_Commons_Attribution[ -]Non-?Commercial[ -]Share_?Alike_4\.0\b|creativecommons\.org/licenses/by-nc-sa/4\.0
CC-BY-NC-ND-3.0|Creative_Commons_Attribution[ -]Non-?Commercial[ -]No_?Deriv(?:ative)?s_3\.0\b|creativecommons\.org/licenses/by-nc-nd/3\.0
CC-BY-NC-ND-4.0|Creative_Commons_Attribution[ -]Non-?Commercial[ -]No_?Deriv(?:ative)?s_4\.0\b|creativecommons\.org/licenses/by-nc-nd/4\.0
ODbL-1.0|Open_(?:Data_Commons_Open_)?Database_Licen[sc]e(?:_(?:v)?1\.0)?|opendatacommons\.org/licenses/odbl
ODC-By-1.0|Open_Data_Commons_Attribution_Licen[sc]e(?:_(?:v)?1\.0)?|opendatacommons\.org/licenses/by
PDDL-1.0|Public_Domain_Dedication_and_Licen[sc]e|opendatacommons\.org/licenses/pddl
OGL-UK-3.0|Open_Government_Licen[sc]e,?_(?:version_|v\.?_?)3(?:\.0)?\b|nationalarchives\.gov\.uk/doc/open-government-licence/version/3
OFL-1.1|(?:SIL_)?Open_Font_Licen[sc]e(?:,?_(?:version_|v\.?_?)?1\.1)?|scripts\.sil\.org/OFL
Vim|Vim_Licen[sc]e|vimdoc\.sourceforge\.net/htmldoc/uganda\.html
OpenSSL|OpenSSL_Licen[sc]e|openssl\.org/source/license
PostgreSQL|PostgreSQL_Licen[sc]e|postgresql\.org/about/licen[sc]e
UPL-1.0|Universal_Permissive_Licen[sc]e(?:,?_(?:version_|v\.?_?)?1\.0)?|oss\.oracle\.com/licenses/upl
ZPL-2.1|Zope_Public_Licen[sc]e(?:,?_(?:version_|v\.?_?)?2\.1)?|zope\.org/Resources/ZPL
Intel|Intel_Open_Source_Licen[sc]e|opensource\.org/licen[sc]es?/intel-open-source-license
W3C|W3C_(?:Software_(?:Notice_and_)?)?Licen[sc]e|w3\.org/Consortium/Legal
SSPL-1.0|Server_Side_Public_Licen[sc]e(?:,?_(?:version_|v\.?_?)?1)?|mongodb\.com/licensing/server-side-public-license
BUSL-1.1|Business_Source_Licen[sc]e(?:_1\.1)?|mariadb\.com/bsl11
Elastic-2.0|Elastic_Licen[sc]e(?:_2\.0)?|elastic\.co/licensing/elastic-license
MulanPSL-2.0|Mulan_P(?:ermissive_Software|SL)(?:_Licen[sc]e)?,?_(?:version_|v\.?_?)2|license\.coscl\.org\.cn/MulanPSL2
CeCILL-2.1|CeCILL(?:_FREE_SOFTWARE)?_Licen[sc]e(?:_(?:agreement_)?(?:version_|v)?2\.1)?|cecill\.info/licences/Licence_CeCILL
NPL-1.1|Netscape_Public_Licen[sc]e(?:,?_(?:version_|v\.?_?)?1\.1)?|mozilla\.org/(?:MPL/)?NPL
QPL-1.0|Q_Public_Licen[sc]e(?:,?_(?:version_|v\.?_?)?1\.0)?|opensource\.org/licen[sc]es?/qpl
RPL-1.5|Reciprocal_Public_Licen[sc]e(?:,?_(?:version_|v\.?_?)?1\.5)?|opensource\.org/licen[sc]es?/rpl-1\.5
SISSL|Sun_Industry_Standards_Source_Licen[sc]e|opensource\.org/licen[sc]es?/sisslpl
LPPL-1.3c|LaTeX_Project_Public_Licen[sc]e(?:,?_(?:version_|v\.?_?)?1\.3c?)?|latex-project\.org/lppl
OpenRAIL-M|(?:CreativeML_|BigScience_)?Open_?RAIL(?:\+\+)?-?[MDS]?_Licen[sc]e|huggingface\.co/spaces/[^\s]*license
""".strip().splitlines()

#: license, sentence of its text or notice, keyword
_TEXTS = r"""
MIT|Permission_is_hereby_granted,_free_of_charge,_to_any_person_obtaining_a_copy|permission
MIT|Released_under_the_MIT_Licen[sc]e|licen
MIT|(?:Licen[sc]ed|Distributed|Available)_under_(?:the_)?(?:terms_of_the_)?MIT_Licen[sc]e|licen
Apache-2.0|Licen[sc]ed_under_the_Apache_Licen[sc]e,_Version_2\.0|licen
Apache-2.0|you_may_not_use_this_file_except_in_compliance_with_the_Licen[sc]e|compliance
Apache-1.1|This_product_includes_software_developed_by_the_Apache_Software_Foundation|apache
BSD-2-Clause|Redistribution_and_use_in_source_and_binary_forms,_with_or_without_modification,_are_permitted|redistribution
BSD-3-Clause|Neither_the_name_of_(?:the_)?[^.\n]{1,80}_nor_the_names_of_(?:its|any)_contributors_may_be_used|contributors
BSD-4-Clause|All_advertising_materials_mentioning_features_or_use_of_this_software_must_display|advertising
ISC|Permission_to_use,_copy,_modify,_and(?:/or)?_distribute_this_software_for_any_purpose_with_or_without_fee|permission
Zlib|This_software_is_provided_'as-is',_without_any_express_or_implied_warranty|warranty
BSL-1.0|Permission_is_hereby_granted,_free_of_charge,_to_any_person_or_organization_obtaining_a_copy|permission
GPL-3.0|This_(?:work|program|software|file)_is_licen[sc]ed_under_the_GNU_General_Public_Licen[sc]e,_version_3|licen
GPL-2.0|This_(?:work|program|software|file)_is_licen[sc]ed_under_the_GNU_General_Public_Licen[sc]e,_version_2|licen
GPL|This_program_is_free_software[:;,]_you_can_redistribute_it_and/or_modify_it_under_the_terms_of_the_GNU_General_Public|redistribute
LGPL|This_library_is_free_software[:;,]_you_can_redistribute_it_and/or_modify_it_under_the_terms_of_the_GNU_(?:Lesser|Library)|redistribute
GPL|You_should_have_received_a_copy_of_the_GNU_General_Public_Licen[sc]e|licen
LGPL|You_should_have_received_a_copy_of_the_GNU_(?:Lesser|Library)_General_Public_Licen[sc]e|licen
AGPL-3.0|You_should_have_received_a_copy_of_the_GNU_Affero_General_Public_Licen[sc]e|licen
GFDL|Permission_is_granted_to_copy,_distribute_and/or_modify_this_document|permission
MPL-2.0|This_Source_Code_Form_is_subject_to_the_terms_of_the_Mozilla_Public_Licen[sc]e,_v\._2\.0|licen
MPL-1.1|The_contents_of_this_file_are_subject_to_the_Mozilla_Public_Licen[sc]e_Version_1\.1|licen
EPL-1.0|All_rights_reserved\._This_program_and_the_accompanying_materials_are_made_available_under_the_terms_of_the_Eclipse_Public_Licen[sc]e_v1\.0|licen
EPL-2.0|This_program_and_the_accompanying_materials_are_made_available_under_the_terms_of_the_Eclipse_Public_Licen[sc]e_(?:v_?)?2\.0|licen
Unlicense|This_is_free_and_unencumbered_software_released_into_the_public_domain|public
CC0-1.0|has_waived_all_copyright_and_related_or_neighboring_rights|neighboring
CC-BY-NC-4.0|Licen[sc]ed_under_(?:a_)?(?:the_)?CC[ -]BY-NC(?:_|-)4\.0|licen
CC-BY-NC-SA-4.0|Licen[sc]ed_under_(?:a_)?(?:the_)?CC[ -]BY-NC-SA(?:_|-)4\.0|licen
CC-BY-NC-ND-4.0|Licen[sc]ed_under_(?:a_)?(?:the_)?CC[ -]BY-NC-ND(?:_|-)4\.0|licen
CC-BY-SA-4.0|Licen[sc]ed_under_(?:a_)?(?:the_)?CC[ -]BY-SA(?:_|-)4\.0|licen
CC-BY-SA-3.0|Licen[sc]ed_under_(?:a_)?(?:the_)?CC[ -]BY-SA(?:_|-)3\.0|licen
CC-BY-4.0|Licen[sc]ed_under_(?:a_)?(?:the_)?CC[ -]BY(?:_|-)4\.0|licen
CC-BY-3.0|Licen[sc]ed_under_(?:a_)?(?:the_)?CC[ -]BY(?:_|-)3\.0|licen
CC-BY-ND-4.0|Licen[sc]ed_under_(?:a_)?(?:the_)?CC[ -]BY-ND(?:_|-)4\.0|licen
CC-BY|This_work_is_licen[sc]ed_under_a_Creative_Commons_Attribution|licen
WTFPL|Everyone_is_permitted_to_copy_and_distribute_verbatim_or_modified_copies_of_this_licen[sc]e|licen
OFL-1.1|This_Font_Software_is_licen[sc]ed_under_the_SIL_Open_Font_Licen[sc]e|licen
NCSA|Permission_is_hereby_granted,_free_of_charge,_to_any_person_obtaining_a_copy_of_this_software_and_associated_documentation_files_\(the_"Software"\),_to_deal_with_the_Software|permission
X11|Except_as_contained_in_this_notice,_the_name_of_the_X_Consortium_shall_not_be_used|consortium
PSF-2.0|This_LICENSE_AGREEMENT_is_between_the_Python_Software_Foundation|licen
OpenSSL|This_product_includes_software_developed_by_the_OpenSSL_Project|openssl
Artistic-2.0|This_is_free_software_licen[sc]ed_under_the_Artistic_Licen[sc]e_2\.0|licen
Public-Domain|(?:hereby_)?(?:placed|released|dedicated)_(?:in|into|to)_the_public_domain|public
Proprietary|(?:proprietary_and_confidential|confidential_and_proprietary)|proprietary
Proprietary|Unauthori[sz]ed_copying_of_this_(?:file|document|work)|copying
Proprietary|All_rights_reserved|reserved
Copyright|Copyright_(?:\(c\)_|©_)?(?:19|20)\d\d(?:\s*[-,]\s*(?:19|20)\d\d)*|copyright
""".strip().splitlines()

_TAGS = (
    "MIT MIT-0 Apache-1.1 Apache-2.0 ISC 0BSD BSD-2-Clause BSD-3-Clause BSD-3-Clause-Clear BSD-4-Clause BSL-1.0 Zlib X11 NCSA PostgreSQL UPL-1.0 Unlicense WTFPL "
    "GPL-1.0-only GPL-1.0-or-later GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later GPL-2.0 GPL-3.0 GPL-2.0+ GPL-3.0+ LGPL-2.0-only LGPL-2.0-or-later "
    "LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later LGPL-2.1 LGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later AGPL-3.0 GFDL-1.2-only GFDL-1.3-only GFDL-1.3-or-later "
    "MPL-1.0 MPL-1.1 MPL-2.0 EPL-1.0 EPL-2.0 CDDL-1.0 CDDL-1.1 CPL-1.0 EUPL-1.1 EUPL-1.2 Artistic-1.0 Artistic-2.0 AFL-3.0 OSL-3.0 ECL-2.0 MS-PL MS-RL PSF-2.0 PHP-3.01 Ruby "
    "CC0-1.0 CC-BY-2.0 CC-BY-3.0 CC-BY-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC-BY-NC-4.0 CC-BY-NC-SA-4.0 CC-BY-NC-ND-4.0 CC-BY-ND-4.0 ODbL-1.0 ODC-By-1.0 PDDL-1.0 OFL-1.1 Vim OpenSSL "
    "ZPL-2.1 W3C SSPL-1.0 BUSL-1.1 Elastic-2.0 MulanPSL-2.0 CECILL-2.1 LPPL-1.3c"
).split()


_KEYS = {"MIT-0": "attribution", "0BSD": "bsd", "MulanPSL-2.0": "mulan", "CC0-1.0": "cc0", "PDDL-1.0": "dedication"}


@lru_cache(1)
def rules() -> tuple[Rule, ...]:
    """All rules in order; a higher priority wins: tags over addresses over sentences over names over remarks."""
    out: list[Rule] = []
    for n, tag in enumerate(_TAGS):
        out.append(Rule(f"tag-{n:03d}", tag, "tag", 50, "spdx", rf"SPDX-Licen[sc]e-Identifier:\s*\(?{re.escape(tag)}(?![\w.+-])"))
    for n, line in enumerate(_NAMES):
        lic, rest = line.split("|", 1)
        depth, bar = 0, 0
        for bar, c in enumerate(re.sub(r"\\.", "..", rest)):  # the name and the address stand on either side of the bar outside all brackets
            depth += (c == "(") - (c == ")")
            if c == "|" and not depth:
                break
        name, url = rest[:bar], rest[bar + 1 :]
        lic = lic.removesuffix("-alt")
        key = _KEYS.get(lic) or ("commons" if "Creative_Commons" in name else "licen")
        if "Creative_Commons_Zero" in name:
            key = "commons"
        out.append(Rule(f"name-{n:03d}", lic, "name", 25 if re.search(r"\d", lic) else 20, key, _spaces(rf"(?<![\w-]){name}")))
        if url:
            host = re.match(r"(?:[\w-]|\\\.)+", url)[0].replace("\\", "")
            out.append(Rule(f"url-{n:03d}", lic, "url", 40, host.lower(), url))
    for n, line in enumerate(_TEXTS):
        lic, rest = line.split("|", 1)
        text, key = rest.rsplit("|", 1)
        out.append(Rule(f"text-{n:03d}", lic, "text", 5 if lic in ("Copyright", "Proprietary") else 10 if lic == "Public-Domain" else 30, key, _spaces(text)))
    return tuple(out)


def _spaces(pattern: str) -> str:
    return pattern.replace("_?", r"\s*").replace("_", r"\s+")


@lru_cache(1)
def compiled() -> tuple[tuple[Rule, re.Pattern], ...]:
    return tuple((r, re.compile(r.pattern, re.I | re.A)) for r in rules())


def resolve(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of (start, stop, number of the rule) the detections that stay, by place."""
    rank = compiled()
    taken: list[tuple[int, int, int]] = []
    for s, e, n in sorted(found, key=lambda f: (-rank[f[2]][0].priority, f[0] - f[1], f[2], f[0])):
        if not any((a <= s and e <= b) or (s <= a and b <= e) for a, b, _ in taken):
            taken.append((s, e, n))
    return sorted(taken)


def detect(text: str, having: set[str] | None = None) -> list[tuple[int, int, int]]:
    """Detections in one text; ``having`` are the keywords it has (None: run every rule)."""
    found = [(m.start(), m.end(), n) for n, (r, p) in enumerate(compiled()) if having is None or r.keyword in having for m in p.finditer(text)]
    return resolve(found) if found else []


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each detection that stays: doc_id, license_id, rule_id, kind, start and stop (characters), matched.

    No shuffle. Null and empty texts have no detections; rows with the same id are scanned each by itself; a null id
    is carried along; other columns aren't read."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = compiled()
        keywords = sorted({r.keyword for r, _ in table})
        for b in batches:
            data, off, _ = flat(b.column(1))
            rows: list[tuple] = []
            for i, j in slices(off):
                raw = data[off[i] : off[j]].tobytes()
                low = raw.lower()
                own = off[i : j + 1] - off[i]
                having: dict[int, set[str]] = {}
                for k in keywords:
                    key, at = k.encode(), low.find(k.encode())
                    while at >= 0:
                        d = int(np.searchsorted(own, at, "right")) - 1
                        if at + len(key) <= own[d + 1]:
                            having.setdefault(d, set()).add(k)
                            at = low.find(key, int(own[d + 1]))
                        else:
                            at = low.find(key, at + 1)
                for d, keys in sorted(having.items()):
                    text = raw[own[d] : own[d + 1]].decode()
                    rows += [(i + d, table[n][0], s, e, text[s:e]) for s, e, n in detect(text, keys)]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).take(pa.array([r[0] for r in rows])).cast(pa.int64()),
                        *(pa.array([getattr(r[1], k) for r in rows], pa.string()) for k in ("license_id", "rule_id", "kind")),
                        pa.array([r[2] for r in rows], pa.int32()),
                        pa.array([r[3] for r in rows], pa.int32()),
                        pa.array([r[4] for r in rows], pa.string()),
                    ],
                    names=["doc_id", "license_id", "rule_id", "kind", "start", "stop", "matched"],
                )

    return docs.select(docs[f"`{id_col}`"].cast("long").alias("doc_id"), docs[f"`{text_col}`"].cast("string").alias("text")).mapInArrow(tidied(run), RESULT)
