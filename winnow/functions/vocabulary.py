"""Everyday review vocabulary that looks like identifiers.

A reviewer writes such words as concepts, not as names in the code, so the grounding check passes
them over. The list is a default of our own; a run that needs another set passes it as ``vocabulary``.
"""

from __future__ import annotations

REVIEW_VOCABULARY = """
a an and any are as at be before but by can do does for from has have if in into is it its may must no not
of on only or other so such than that the their then there these this those to was were when where which
while who will with without
access action address algorithm analysis api application argument arguments array assignment attack attacker
authentication authorization behavior boolean branch buffer bug bytes cache call calls case certificate
check checks cipher class client code command comment condition config configuration constant constructor
content context control cookie credential credentials csrf data database decorator default dependency digest
directory encoding encryption endpoint environment error escape escaping example exception exploit expression
field file filter finding flag flow form format framework function functions handler hash header html http
https id import imports index injection input inputs instance integer interface json key keys keyword
language library line lines link list literal log logic loop map message method methods middleware mode
model module name network number object objects operation option options output package parameter
parameters parser password path paths pattern payload permission policy process property query random
read reason redirect reference regex request requests resource response result results return returns risk
role route rule safe sanitization schema scope script secret server session setting settings signature sink
sort source sql ssrf state statement static status string strings structure syntax system table tag taint
template test text thread timeout token tokens type types unsafe url user users validation value values
variable variables version vulnerability web xml xss
""".split()
